"""A context for every conversation, against plain Python."""

from quarry.plans import registry


def test_every_conversation(spark):
    path = "/root/testdata/sf0.01"
    want = {}
    for r in sorted(spark.read.parquet(f"{path}/conversations.parquet").collect(), key=lambda r: r.turn):
        want.setdefault(r.conv_id, []).append(f"[{r.role} {r.turn}]: {r.text}")
    got = registry.queries()["rag_context_each"](spark, path).collect()
    assert len(got) == len(want) > 1
    assert {r.conv_id: r.context for r in got} == {k: "\n\n".join(v) for k, v in want.items()}
