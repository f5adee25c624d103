"""Quote blocks, versions by mark, state machines and scope fields on rows of their own."""

from pyspark.sql import functions as F

from tenderflow.operators import history, rollup, transitions


def test_quote_sections(spark):
    schema = "q int, seq int, division string, group_type string, group string, opening_size string, ext_price double"
    rows = [(1, 2, "08 71", None, "101", "7-0", 0.1), (1, 1, "08 71", None, "101", "3-0", 0.2), (1, 3, None, None, None, None, None), (1, 4, "10 28", "door", "101", None, 5.0), (1, 5, "32", None, "", None, 1.0), (1, 6, " 06", "odd", "z", None, 2.0)]
    found = rollup.quote_sections(spark.createDataFrame(rows, schema), ["q"], "seq").orderBy("place", "group").collect()
    assert [(r.place, r.section, r.group, r.opening_size, r.n_lines, r.subtotal, r.section_total) for r in found] == [
        (1, "door", "101", "3-0", 3, 5.3, 5.3), (1, "door", "Doors, Frames & Hardware", None, 1, 0.0, 5.3), (3, "frp", "z", None, 1, 2.0, 2.0), (4, "other", "Other", None, 1, 1.0, 1.0)
    ]


def test_marked_diff(spark):
    schema = "p int, seq int, mark string, description string, qty int, finish string"
    long = "d" * 70
    old = spark.createDataFrame([(1, 1, "101", "a", 1, None), (1, 2, "102", "b", 1, "x"), (1, 3, "", long + "1", 1, "x"), (1, 4, None, long + "2", 2, "x"), (2, 1, "101", "a", 1, "x")], schema)
    new = spark.createDataFrame([(1, 1, "101", "a", 1, "None"), (1, 2, "103", "b", 1, "x"), (1, 3, "", long + "3", 3, "x"), (2, 1, "101", "zz", 1, "x")], schema)
    rows = {(r.p, r.mark): (r.change, r.fields, r.before, r.after) for r in history.marked_diff(old, new, "p", ["qty", "finish"], "seq").collect()}
    assert rows == {
        (1, "101"): ("changed", ["finish"], {"finish": None}, {"finish": "None"}), (1, "102"): ("removed", None, None, None), (1, "103"): ("added", None, None, None), (1, long[:60]): ("changed", ["qty"], {"qty": "2"}, {"qty": "3"})
    }


def test_judged_steps(spark):
    schema = "k int, seq int, status string, actor string, system boolean"
    rows = [(1, 1, "draft", "a", None), (1, 2, "priced", None, None), (1, 3, "pendingReview", None, None), (1, 4, "approved", " ", None), (1, 5, "sent", None, None), (1, 6, "draft", "a", None), (2, 1, "pendingReview", None, None), (2, 2, "approved", "ann", None), (2, 3, "superseded", None, True), (2, 4, "odd", "a", None), (2, 5, "draft", "a", None)]
    found = {(r.k, r.seq): r.fault for r in transitions.judged_steps(spark.createDataFrame(rows, schema), "version", "k", [F.col("seq")]).collect()}
    assert found == {(1, 2): None, (1, 3): None, (1, 4): "person", (1, 5): None, (1, 6): "transition", (2, 2): None, (2, 3): None, (2, 4): "transition", (2, 5): "transition"}
    assert spark.range(1).select(transitions.next_states("rfq", F.lit("awaiting")).alias("a")).first().a == ["received", "expired", "cancelled"]
    assert spark.range(1).select(transitions.next_states("rfi", F.lit("nothing")).alias("a")).first().a == []


def test_filled_scope(spark):
    stored = spark.createDataFrame([(1, "", None, ["a", " b "]), (2, "mine", "OH", None), (3, None, "", [])], "k int, name string, state string, alternates array<string>")
    sources = "field_sources map<string, struct<page: int, file: string, excerpt: string>>, source_page int, files array<string>"
    found = spark.createDataFrame([(1, "theirs", "TX", ["b", "c", " "], {"name": (4, "x.pdf", " said ")}, 9, ["f.pdf"]), (2, "theirs", "TX", ["", None], None, None, None)], f"k int, name string, state string, alternates array<string>, {sources}")
    rows = {r.k: r for r in history.filled_scope(stored, found, "k", ["name", "state"], ["alternates"]).collect()}
    assert (rows[1].name, rows[1].state, rows[1].alternates, rows[1].filled) == ("theirs", "TX", ["a", "b", "c"], ["name", "state", "alternates"])
    assert {k: tuple(v) for k, v in rows[1].sources.items()} == {"name": (4, "x.pdf", "said"), "state": (9, "f.pdf", None), "alternates": (9, "f.pdf", None)}
    assert (rows[2].name, rows[2].state, rows[2].alternates, rows[2].filled, rows[2].sources) == ("mine", "OH", None, [], {})
    assert (rows[3].name, rows[3].state, rows[3].alternates, rows[3].filled) == (None, "", [], [])
