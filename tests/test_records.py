"""Scores, patches, feedback and reuse on rows of their own."""

import datetime

from pyspark.sql import functions as F

from tenderflow.operators import accuracy, learning, patches, reuse

DAY = datetime.datetime(2024, 5, 1)


def test_golden_score(spark):
    """Covered, wrong, left blank, invented, named unknown, a row that was not read, and one that is not in the reference."""
    golden = spark.createDataFrame([("1", "a", "x", None), (" 2", "b", None, None), ("3", "c", "z", ["g"]), ("4", "d", None, None), ("", "e", "e", None)], "k string, f string, g string, unknown array<string>")
    actual = spark.createDataFrame([("1", " A", "y"), ("2", None, ""), ("3", "c", "Z"), ("5", "q", "q")], "k string, f string, g string")
    rows = {(r.k, r.field): r.verdict for r in accuracy.compared(actual, golden, "k", ["f", "g"]).collect()}
    assert rows == {("1", "f"): "covered", ("1", "g"): "silent", ("2", "f"): "open", ("2", "g"): "honest", ("3", "f"): "covered", ("3", "g"): "silent", ("4", "f"): "missing", ("4", "g"): None}
    r = accuracy.golden_score(actual, golden, "k", ["f", "g"]).first()
    assert (r.expected, r.found, r.missing, r.extra) == (4, 4, 1, 1)
    assert (r.covered, r.available, r.honest, r.absent, r.silent, r.coverage, r.honesty) == (2, 5, 1, 2, 2, 0.4, 0.5)
    r = accuracy.golden_score(actual.limit(0), golden.limit(0), "k", ["f", "g"]).first()
    assert (r.expected, r.coverage, r.honesty) == (0, 1.0, 1.0)


def test_patches(spark):
    schema = "seq long, path string, op string, value string, source_page int, excerpt string"
    rows = [
        (1, "openings/101/width", "set", "36", 4, "3-0"), (2, " /openings/101/width/ ", None, "40", 5, "3-4"), (3, "openings/101/width", "set", "wide", 5, "x"), (4, "openings/999/width", "set", "1", 1, "x"),
        (5, "101/width", "set", "1", 1, "x"), (6, "openings/101/confirmed_by", "set", "me", 1, "x"), (7, "openings/101/color", "set", "red", 1, "x"), (8, "openings/101/width", "set", "1", None, "x"), (9, "openings/101/width", "set", "1", 2, " "),
        (10, "lines/a1/notes", "append", "n1", None, None), (11, "lines/A1/notes", "set", "n2", 3, "e" * 130), (12, "lines/A1/notes", "append", "n3", None, None), (13, "openings/101/width", "move", "1", 1, "x"), (14, "openings/101/width", "append", "1", 1, "x"),
        (15, "openings/101/flags", "append", "f", None, None), (16, None, "set", "1", 1, "x"),
    ]
    marks = spark.createDataFrame([("101",), ("a1",), ("",), (None,)], "mark string")
    found = patches.judged(spark.createDataFrame(rows, schema), marks, ["width", "notes", "flags"], ["notes", "flags"], {"width": lambda v: v.try_cast("int") > 0})
    reasons = {r.seq: r.reason for r in found.collect()}
    assert reasons == dict(zip(range(1, 17), [None, None, "contract", "mark", "path", "protected", "field", "evidence", "evidence", None, None, None, "op", "contract", None, "path"], strict=True))
    cells = {(r.mark, r.field): (r["values"], r.anew) for r in patches.patched_cells(found, ["notes", "flags"]).collect()}
    assert cells == {("101", "width"): (["40"], True), ("A1", "notes"): (["n2", "n3"], True), ("101", "flags"): (["f"], False)}
    notes = {r.mark: (r.flags, r.evidence_note) for r in patches.patch_notes(found).collect()}
    assert notes["101"] == (["patch_rejected_color", "patch_rejected_confirmed_by", "patch_rejected_width", "patch_unevidenced_width"], "width <- p4: 3-0; width <- p5: 3-4")
    assert notes["A1"] == ([], "notes <- p3: " + "e" * 120)


EVENT = "event_id long, event_type string, spec_key string, spec string, proposed_item string, corrected_item string, reason string, occurred_at timestamp, user string"


def event(i, kind="matchCorrected", key="k", corrected="c", reason=None):
    return (i, kind, key, f"s{i}", f"p{i}", corrected, reason, DAY + datetime.timedelta(hours=i), f"u{i}")


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    first = spark.createDataFrame([event(1), event(2, learning.REJECTED, reason="too dear"), event(3, key=" "), event(4, corrected=None), event(1)], EVENT)
    second = spark.createDataFrame([event(2, learning.REJECTED), event(6, key="other", reason="x"), event(7)], EVENT)
    assert learning.drain(first, 0, folder) == {"read": 4, "learned": 1, "rejected": 1, "skipped": 2}
    assert learning.drain(second, 1, folder) == {"read": 2, "learned": 2, "rejected": 0, "skipped": 0}
    state = sorted(learning.learned(spark, folder).collect())
    assert [(r.spec_key, r.confirms, r.rejects, r.reasons, r.last_item, r.last_spec, r.confirmed_by) for r in state] == [("k", 2, 1, ["too dear"], "c", "s7", "u7"), ("other", 1, 0, ["x"], "c", "s6", "u6")]
    for batch, frame in ((1, second), (0, first), (2, first), (3, second.limit(0))):
        learning.drain(frame, batch, folder)
        assert sorted(learning.learned(spark, folder).collect()) == state


def test_the_store_is_fed_by_a_stream_that_restarts(spark, tmp_path):
    folder, source = str(tmp_path / "store"), tmp_path / "in"
    source.mkdir()
    for rows in ([event(1), event(2)], [event(2), event(3, learning.REJECTED)]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(source))
        query = spark.readStream.schema(EVENT).parquet(str(source)).writeStream.foreachBatch(lambda df, i: learning.drain(df, i, folder) and None)
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.confirms, r.rejects) for r in learning.learned(spark, folder).collect()] == [(2, 1)]


def test_only_changed_partitions_are_computed(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = spark.createDataFrame([(k % 4, k, f"t{k}") for k in range(40)], "part int, k long, t string")
    asked = []

    def double(frame):
        asked.append(sorted(r.part for r in frame.select("part").distinct().collect()))
        return frame.groupBy("part").agg(F.sum(2 * F.col("k")).alias("total"))

    def table():
        return {r.part: r.total for r in reuse.current(spark, "part", folder).collect()}

    assert reuse.refresh(rows, "part", "1", double, folder) == {"computed": 4, "reused": 0, "dropped": 0}
    expected = {p: sum(2 * k for k in range(40) if k % 4 == p) for p in range(4)}
    assert table() == expected
    files = sorted(str(p) for p in tmp_path.rglob("*"))
    assert reuse.refresh(rows.repartition(7), "part", "1", double, folder) == {"computed": 0, "reused": 4, "dropped": 0}
    assert sorted(str(p) for p in tmp_path.rglob("*")) == files and len(asked) == 1
    changed = rows.where("part <> 3").withColumn("k", F.when(F.col("k") == 5, 6).otherwise(F.col("k")))
    assert reuse.refresh(changed, "part", "1", double, folder) == {"computed": 1, "reused": 2, "dropped": 1}
    assert asked[1] == [1] and table() == {0: expected[0], 1: expected[1] + 2, 2: expected[2]}
    assert reuse.refresh(changed.union(changed.where("k = 8")), "part", "1", double, folder)["computed"] == 1
    assert reuse.refresh(changed, "part", "2", double, folder) == {"computed": 3, "reused": 0, "dropped": 0}


def test_an_unknown_watermark_reuses_nothing(spark):
    entries = spark.createDataFrame([(1, "0.75", "a", "w"), (2, "0.74", "a", "w"), (3, "x", "a", "w"), (4, "0.9", "b", "w"), (5, "0.9", None, "w"), (6, None, "a", "w")], "k int, confidence string, sheet string, mark string")
    assert [r.k for r in reuse.reusable(entries, {"sheet": "a", "mark": "w"}).collect()] == [1]
    assert reuse.reusable(entries, {"sheet": "a", "mark": None}).count() == 0


def test_keys_do_not_depend_on_order(spark):
    frame = spark.createDataFrame([("x", None)], "b string, a string")
    one, two = reuse.content_key(["a", "b"], op="text", version="1"), reuse.content_key(["b", "a"], version="1", op="text")
    r = frame.select(one.alias("one"), two.alias("two"), reuse.content_key(["a", "b"], op="text", version="2").alias("other")).first()
    assert r.one == r.two != r.other
