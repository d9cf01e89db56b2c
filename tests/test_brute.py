"""Queries without SQL against plain Python, over the smallest tables."""

import collections
import hashlib
import re

import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"
STOP = {"the", "be", "to", "of", "and", "that", "have", "with"}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def stripped_lines(t):
    return [x.strip() for x in (t or "").split("\n") if x.strip()]


def grams_fired(t):
    w, out = t.split(), []
    for n, most in ((2, 0.20), (3, 0.18), (4, 0.16)):
        c = collections.Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        top = max(((k, len(g)) for g, k in c.items()), default=(0, 0))
        if top[0] > 1 and top[0] * top[1] / len(t) > most:
            out.append(f"gopher_rep_top_{n}_gram")
    for n, most in ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)):
        seen, again, i = set(), 0, 0
        while i + n <= len(w):
            g = tuple(w[i : i + n])
            if g in seen:
                again += sum(map(len, g))
                i += n
            else:
                seen.add(g)
                i += 1
        if t and again / len(t) > most:
            out.append(f"gopher_rep_duplicated_{n}_n_grams")
    return out


def share(a, b):
    return a / b if b else 0.0


def page_reasons(t):
    """The repetition and quality checks on a text, in order."""
    w, ls = t.split(), stripped_lines(t)
    ps = [p.strip() for p in re.split(r"\n{2,}", t) if p.strip()]
    dup = lambda x: 1 - len(set(x)) / len(x) if x else 0.0
    chars = lambda x: share(sum(map(len, x)) - sum(map(len, set(x))), len(t))
    out = [n for n, bad in (("dup_para_frac", dup(ps) > 0.3), ("dup_para_char_frac", chars(ps) > 0.2), ("dup_line_frac", dup(ls) > 0.3), ("dup_line_char_frac", chars(ls) > 0.2)) if bad]
    out = [f"gopher_rep_{n}" for n in out] + grams_fired(t)
    mean = share(sum(map(len, w)), len(w))
    quality = (
        ("gopher_short_doc", len(w) < 50), ("gopher_long_doc", len(w) > 100000), ("mean_word", not 3 <= mean <= 10),
        ("symbol_ratio", share(len(re.findall(r"#|\.\.\.|…", t)), len(w)) > 0.1), ("bullets", share(sum(x[0] in "•‣►-*" for x in ls), len(ls)) > 0.9),
        ("ellipses", share(sum(x.endswith(("...", "…")) for x in ls), len(ls)) > 0.3), ("gopher_below_alpha_threshold", share(sum(any(c.isalpha() for c in x) for x in w), len(w)) < 0.8),
        ("stop_words", len(STOP & set(w)) < 2),
    )
    return out + [f"gopher_qual_{n}" for n, bad in quality if bad]


def fw_reasons(r):
    raw = r.text
    t = "\n".join(x for x in re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", raw or "") if x.strip())
    out = ["extract_failed"] if raw is None else ["extract_empty"] if not raw.strip() else []
    if r.lang != "en":
        out.append(f"lang_{r.lang}")
    out += page_reasons(t)
    policy = ("javascript", "terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies")
    kept = [x for x in stripped_lines(t) if len(x.split()) >= 3 and not any(len(y) > 1000 for y in x.split()) and not any(p in x.lower() for p in policy)]
    left = "\n".join(kept)
    if "lorem ipsum" in t.lower():
        out.append("c4_lorem_ipsum")
    elif "{" in t:
        out.append("c4_curly_bracket")
    elif len(re.findall(r"[.!?]+(?:\s|$)", left)) < 5:
        out.append("c4_too_few_sentences")
    if not left:
        return out + ["empty_after_c4", "error_ZeroDivisionError"]
    dup = (sum(map(len, kept)) - sum(map(len, set(kept)))) / len(left)
    last = (("line_punct_ratio", share(sum(x[-1] in '.!?"”' for x in kept), len(kept)) < 0.12), ("short_line_ratio", share(sum(len(x) <= 30 for x in kept), len(kept)) > 0.67), ("char_dup_ratio", dup > 0.01), ("list_ratio", share(left.count("\n"), len(left.split())) > 0.3))
    return out + [f"fineweb_{n}" for n, bad in last if bad]


def test_second_chain(spark, docs):
    got = {r.doc_id: r for r in catalog.QUERIES["fw_chain"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in docs.items():
        want = fw_reasons(r)
        assert got[i].all_reasons == ",".join(want), i
        assert got[i].reason == (want[0] if want else None) and got[i].kept == (not want)
        assert got[i].diag_raw == any(x.startswith("gopher_rep") for x in page_reasons(r.text or ""))
    assert len({x for i in docs for x in fw_reasons(docs[i])}) > 8


def test_repetition_hist(spark, docs):
    want = collections.Counter(x for r in docs.values() for x in grams_fired(r.text or ""))
    assert {r.reason: r.n for r in catalog.QUERIES["fw_repetition_hist"](spark, SF).collect()} == dict(want)


def test_repetition_of_odd_texts():
    from millrace.functions.repetition import fired, shares

    for t in ("", " ", "a", "a a a a a a a a a a a a", "x y " * 300, " ".join(f"w{i % 7}" for i in range(200)), "a b c d e f g h i j " * 4 + "tail"):
        assert fired(t) == grams_fired(t)
    assert shares("a b c d e a b c d e")["cov_5"] == 1.0 and shares("a b c d e f a b c d x e")["cov_5"] == 0.0


def test_bfd_pack(spark, docs):
    got = {r.shard: (r.bins, r.n, r.total) for r in catalog.QUERIES["bfd_pack"](spark, SF).collect()}
    by = collections.defaultdict(list)
    for r in docs.values():
        if r.n_chars and 0 < r.n_chars <= 32768:
            by[f"{r.source}-{r.doc_id // 2048}"].append(r.n_chars)
    for source, sizes in by.items():
        rooms = []
        for n in sorted(sizes, reverse=True):
            fit = [k for k, room in enumerate(rooms) if room >= n]
            if fit:
                k = min(fit, key=lambda k: rooms[k])
                rooms[k] -= n
            else:
                rooms.append(32768 - n)
        assert got[source] == (len(rooms), len(sizes), sum(sizes))


def test_shard_schedule(spark, docs):
    sizes, load, want = collections.Counter(), [0] * 4, {}
    for r in docs.values():
        sizes[r.source] += r.n_chars or 0
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        want[name] = load.index(min(load))
        load[want[name]] += size
    assert {r.name: r.worker for r in catalog.QUERIES["shard_schedule"](spark, SF).collect()} == want


def test_derived_programs(spark, docs):
    r = catalog.QUERIES["make_ops_roundtrip"](spark, SF).first()
    assert r.n == len(docs) and r.n_exact == r.n_same >= 0.99 * r.n
    kinds = {x.kind: (x.n, x.n_same) for x in catalog.QUERIES["staged_rows"](spark, SF).collect()}
    long = sum(len([x for i, x in enumerate(stripped_lines(r.text)) if i % 4]) > 1 for r in docs.values())
    assert kinds["edit_ops"][0] >= long - 5 and all(n == same for k, (n, same) in kinds.items() if k == "edit_ops")


def test_edit_effects(spark, docs):
    want = collections.Counter()
    for r in docs.values():
        a, b = stripped_lines(r.text), stripped_lines(re.sub(r"^[^\n]*\n", "", r.text or ""))
        want["unchanged" if a == b else "emptied" if not b else "lines only"] += 1
    assert {r.effect: r.n for r in catalog.QUERIES["edit_effects"](spark, SF).collect()} == dict(want)


def test_prox_execute(spark, docs):
    got = {r.doc_id: r for r in catalog.QUERIES["prox_execute"](spark, SF).collect()}
    for i, r in docs.items():
        t = r.text or ""
        if i % 3 == 0:
            new = "\n".join(t.replace("the", "a").split("\n")[2:])
            few = len(new.split()) <= 10 or len(new.split()) <= 0.05 * len(t.split())  # then nothing is kept
            want = None if not t.split() else hashlib.md5(("" if few else new).encode()).hexdigest()
            assert (got[i].text_md5, got[i].errors) == (want, 0)
        elif i % 3 == 1:
            assert not t.split() or got[i].text_md5 == hashlib.md5(b"").hexdigest()
        else:
            assert not t.split() or got[i].errors == 2 and got[i].text_md5 == hashlib.md5(t.encode()).hexdigest()


def test_rendered_pages(spark, pages):
    """Every word of a page's plain paragraphs is rendered; main content and labels agree with the rendering."""
    got = {r.page_id: r for r in catalog.QUERIES["render_pages"](spark, SF).collect()}
    assert set(got) == {i for i, p in pages.items() if p.html is not None and p.html.strip()}
    main = {r.page_id: r.chars for r in catalog.QUERIES["extract_main"](spark, SF).collect()}
    assert all((main[i] or 0) <= got[i].chars for i in got)
    labels = {r.tag: r.n for r in catalog.QUERIES["dom_labels"](spark, SF).collect() if r.tag is not None}
    noted = {r.page_id: r for r in catalog.QUERIES["annotated_lines"](spark, SF).collect()}
    assert sum(labels.values()) == sum(r.n_lines for r in got.values())
    assert all(noted[i].n_lines == got[i].n_lines and noted[i].n_labelled >= 0.9 * got[i].n_lines for i in got)


def test_lines_by_block():
    from millrace.functions.markup import annotated_lines, attributed

    html = "<body><div class='menu'>Home About</div><article id=x><p class='a b c'>One two three four five six</p><p>Seven eight nine ten eleven twelve</p></article></body>"
    assert attributed(html, ["One two three", "seven  eight", "Home", "three four five six nought", "nothing here at all", "four five six Seven"]) == ["p.a.b", "p", "div.menu", "p.a.b", "", "article.x"]
    assert annotated_lines(html, "Home\n\n zzz ") == "<lid:1|div.menu> Home\n<lid:2> zzz"


def test_head_check_join(spark):
    assert catalog.QUERIES["head_check_join"](spark, SF).count() > 0


def test_bootstrap(spark):
    rows = {r.metric: r for r in catalog.QUERIES["bootstrap_accuracy"](spark, SF).collect()}
    lab = [r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    p, n = sum(lab) / len(lab), len(lab)
    sd = (p * (1 - p) / n) ** 0.5
    assert set(rows) == {"good", "recall", "tokens"}
    assert abs(rows["good"].mean - p) < 0.3 * sd and 1.6 < (p - rows["good"].low) / sd < 2.4 and 1.6 < (rows["good"].high - p) / sd < 2.4
    assert all(r.low <= r.mean <= r.high for r in rows.values())
