"""Streams against the same work on tables."""

import support

from docloom.plans.catalog import QUERIES
from docloom.plans.text_q import DENIALS, NO, UNSURE, YES
from docloom.streaming.audit import audit_sink, read_audit
from docloom.streaming.conversation import conversation_stream


def batches_of(spark, frame, folder, order, n=3):
    """The rows of a frame as n files in order, and a stream that reads one at a time."""
    rows = frame.orderBy(*order).collect()
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], frame.schema).coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_conversation_stream(spark, tmp_path):
    turns = spark.read.parquet(f"{support.SMALL}/conversations.parquet").filter("role = 'user'").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "case conv_id % 3 when 0 then text when 1 then if(turn % 4 < 2, 'Oui', 'non !') else if(turn % 4 < 2, 'no', 'je ne sais pas') end as text")
    stream = batches_of(spark, turns, str(tmp_path / "in"), ["turn", "conv_id"])
    query = conversation_stream(stream, YES, NO, UNSURE, DENIALS).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.conv_id, r.turn): (r.meaning, r.contradicts) for r in spark.table("turns").collect()}
    last, want = {}, {}
    meanings = {(r.conv_id, r.turn): r.meaning for r in spark.table("turns").collect()}
    for key in sorted(meanings, key=lambda k: (k[1], k[0])):
        m = meanings[key]
        clear = m in ("affirmative", "negative")
        want[key] = (m, clear and last.get(key[0]) not in (None, m))
        last[key[0]] = m if clear else last.get(key[0])
    assert got == want and any(x for _, x in got.values()) and len(got) == turns.count()
    table = {(r.conv_id, r.turn): r.meaning for r in QUERIES["c2_c7_conversation_state"](spark, support.SMALL).collect()}
    assert all(meanings[k] == table[k] for k in meanings if k[0] % 3 == 0)


def test_audit_sink_replaces_and_rotates(spark, tmp_path):
    events = spark.range(90).selectExpr("id", "concat('e', id) as what")
    stream = batches_of(spark, events, str(tmp_path / "in"), ["id"])
    folder = str(tmp_path / "log")
    for _ in range(2):
        query = audit_sink(stream, folder, str(tmp_path / "c"), most_rows_a_file=20, batches_kept=2)
        query.processAllAvailable()
        query.stop()
    kept = read_audit(spark, folder, "id long, what string").collect()
    assert sorted(r.id for r in kept) == list(range(30, 90)) and {r.batch for r in kept} == {1, 2}
