import hashlib

from spanwarden.llm import token_output


def test_digests_are_of_written_shards(docs, tmp_path):
    path = f"{tmp_path}/shards"
    got = token_output.digests(docs, path=f"file://{path}", seq_len=32, shard_slots=16).collect()
    size = 0
    for r in got:
        with open(f"{path}/shard-{r['shard']:08d}.bin", "rb") as f:
            f.seek(r["byte_offset"])
            assert hashlib.sha256(f.read(64)).hexdigest() == r["record_sha256"] and r["byte_offset"] == r["slot"] % 16 * 64
    size = sum(f.stat().st_size for f in tmp_path.glob("shards/*"))
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and size == 64 * len(got)
