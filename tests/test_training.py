from millrace.operators import training as S

FULL = "Home Login Register\nBest Widgets\nThe widget is fast [Share] and red.\nIt costs 5 dollars.\nFollow us"
DRIP = "Best Widgets\nThe widget is fast [Share] and red.\nIt costs 5 dollars."


def test_staged_kinds():
    assert S.staged(FULL, DRIP, "<extract>\n" + DRIP) == ("<extract>\nrm 1\nrm 5\n<keep>", "keep")
    assert S.staged(FULL, DRIP, "<refine>\nBest Widgets\nThe widget is fast and red.\nIt costs 5 dollars.") == ('<extract>\nrm 1\nrm 5\n<edit>\nsub 3: "[Share] "', "edit_ops")
    assert S.staged(FULL, DRIP, "<refine>\nBest Widgets\nIt costs 5 dollars.") == ("<extract>\nrm 1\nrm 5\n<edit>\nrm 3", "edit_ops")
    assert S.staged(FULL, DRIP, "<refine>\nnew")[1] == "edit_fulltext_fallback"
    assert S.staged(FULL, DRIP, "<refine>\n" + DRIP)[1] == "refine_noop_to_keep"
    assert S.staged(FULL, DRIP, "<delete>")[1] == "delete"
    assert S.staged(FULL, DRIP, "<rewrite>\nx ") == ("<extract>\nrm 1\nrm 5\n<rewrite>\nx", "rewrite")
    assert S.staged(FULL, DRIP + "\nextra", "<delete>") == (None, "stage1_not_subset")
    assert S.staged(FULL, "Best Widgets\nThe widget is fast and red.", "<delete>")[0] is None
    assert S.staged("a\nb\nc\nd\ne", "a\nc\nd", "<refine>\na") == ("<extract>\nrm 2\nrm 5\n<edit>\nrm 3-4", "edit_ops")
