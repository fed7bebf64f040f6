"""Every tool result that answers no call comes out as a row of its own."""

from twinlens.llm import toolcalls


def test_each_orphan_is_a_row(spark):
    calls = spark.createDataFrame([(1, "a", 0, "f", "{}")], "conv_id long, call_id string, turn long, name string, arguments string")
    rows = [(1, "a", 1, "hit"), (1, None, 2, "x"), (1, None, 3, "y"), (None, None, 4, "z"), (None, None, 5, "w"), (1, "gone", 6, "p"), (1, "gone", 7, "q")]
    results = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, content string")
    got = toolcalls.link(calls, results, {}).collect()
    lost = [r for r in got if r.status == "orphan_result"]
    assert sorted(r.turn for r in lost) == [2, 3, 4, 5, 6, 7] and all(r.n_results == 1 for r in lost) and len(got) == 7
    assert sorted(r.json.split('"result":')[1] for r in lost) == ['"p"}', '"q"}', '"w"}', '"x"}', '"y"}', '"z"}']
