"""A directory of corpora: the name a training run reads, the folder, and where deduplication takes its input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

ARMS = ["full", "nodel", "noedit", "noext", "norwdel", "norw"]


@dataclass(frozen=True)
class Corpus:
    name: str
    read: str
    folder: str
    dedup_in: str


def directory(root: str) -> dict[str, Corpus]:
    """Every corpus below `root` by name: the curated one, the arms of the operation ablation, which share one inference
    pass, the two-stage refiner, the chunk and line programs, and the rule stacks."""
    made = {"curated": ("curated_norule", "curated", "text_clean"), "two_stage": ("two_stage_norule", "two_stage", "best")}
    made |= {f"ablation_{a}": (f"ablation_{a}_norule", f"operation_ablation/{a}", "text_clean") for a in ARMS}
    made |= {f"{n}_programs": (f"{n}_programs_norule", f"{n}_programs", "text") for n in ("chunk", "line")}
    made |= {f"{n}_rules": (f"{n}_rules", f"rules/{n}", "kept") for n in ("first", "second")}
    return {n: Corpus(n, read, f"{root}/{folder}", f"{root}/{folder}/{sub}") for n, (read, folder, sub) in made.items()}


def frame(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(c.name, c.read, c.folder, c.dedup_in) for c in directory(root).values()], "name string, read string, folder string, dedup_in string")
