"""WARC archives, chat formatting and the pipeline."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatloom.llm import chat, warc
from chatloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


# WARC


def odd_pages(spark):
    rnd = random.Random(3)
    big = "".join(rnd.choice("ab\r\n0é") for _ in range(70000))
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", big), (6, "u\r\nv", big), (7, "http://f", "WARC/1.1\r\n\r\n\r\n\r\n"), (8, "http://g", "x"), (8, "http://g", "x"), (None, "n", "x"), (None, "n", "alone")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1)).withColumn("sha1", F.lit("s"))


def test_archives(shipped):
    rows, pages = odd_pages(shipped)
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    got = warc.archived(pages).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    for r in got:
        payload = next(p for p in groups if warc.payload_digest(p.encode()) == r.payload_digest and len(p.encode()) == r.payload_bytes)
        keeper = max((p for p in groups[payload] if p is not None), default=None)
        if r.record_type == "response":
            assert r.page_id == keeper and r.refers_to is None
        else:
            assert r.refers_to == keeper
    assert sum(r.record_type == "response" for r in got) == len(groups)
    assert max(r.segments for r in got) > 3


def test_archives_of_no_pages(shipped):
    _, pages = odd_pages(shipped)
    assert warc.archived(pages.limit(0)).count() == 0


def test_segments_must_be_complete():
    payload = bytes(range(256)) * 300
    records = [next(iter(warc.read_records(r + b"\r\n\r\n"))) for r in warc.records_of(1, 0, "u", payload, None)]
    parts = [{"origin": "o", "segment": int(h["WARC-Segment-Number"]), "total": int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None, "last": "WARC-Segment-Total-Length" in h, "page_id": 1, "record_type": "response", "refers_to": None, "payload_digest": h["WARC-Payload-Digest"][5:], "payload": b} for h, b in records]
    assert len(parts) > 4
    whole = warc._decoded(parts, True)
    assert whole["verified"] and whole["payload"] == payload
    assert not warc._decoded(parts[:-1], True)["verified"]
    assert not warc._decoded(parts[:2] + parts[3:], True)["verified"]
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"


# chat


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\\\n\n<|/turn|><|turn|>", "<<s>s> [[INST]] <</SYS>>", "é😀"])
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
    formatted, spans = chat.format_turns([("user\n<s>\\", text), ("assistant", text)])
    assert chat.parse_turns(formatted) == [("user\n<s>\\", text), ("assistant", text)]
    assert [chat.unescape(formatted[a : a + n]) for a, n in spans] == [text]


def test_reply_trees(shipped):
    rows = [
        ("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "low", 0.1), ("t", 3, 1, "assistant", "high", 0.9), ("t", 4, 3, "user", "end", 0.5), ("t", 4, 3, "user", "end", 0.5),
        ("u", 10, 99, None, None, None), ("c", 20, 21, "user", "cycle", 1.0), ("c", 21, 20, "user", "cycle", 1.0),
    ]
    df = shipped.createDataFrame([(ord(t), *r) for t, *r in rows], "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0))
    got = chat.format_chats(df, branches=2).collect()
    found = {(chr(r.tree), r.branch): chat.parse_turns(r.formatted) for r in got}
    assert found == {("t", 1): [("user", "root"), ("assistant", "high"), ("user", "end")], ("t", 2): [("user", "root"), ("assistant", "low")], ("u", 1): [("", "")]}


def test_a_comb_of_replies_lists_only_the_chosen_paths(shipped):
    """A thread with a reply at every message has a branch for each; work stays in proportion to the messages."""
    n = 3000
    rows = [(1, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(n)] + [(1, n + i, i, "assistant", f"r{i}", 1.0 if i == 1 else 0.0) for i in range(n - 1)]
    rows += [(2, i, i - 1 if i else None, "user", f"other{i}", 0.0) for i in range(3)]  # the same node numbers in another tree
    paths = chat.reply_paths(shipped.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double"), branches=2).collect()
    got = defaultdict(dict)
    for r in paths:
        got[r.tree, r.branch][r.turn] = r.text
    assert {k: [v[t] for t in sorted(v)] for k, v in got.items() if k != (1, 2)} == {(1, 1): ["m0", "m1", "r1"], (2, 1): ["other0", "other1", "other2"]}
    assert len(got[1, 2]) == n and got[1, 2][n - 1] in (f"m{n - 1}", f"r{n - 2}") and len(paths) == 3 + 3 + n


def test_long_and_odd_conversations(shipped):
    rows = [(1, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(70)] + [(2, 0, None, None), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, "user", "first"), (4, 1, "user", "second")]
    got = {r.tree: r for r in chat.read_chats(chat.format_chats(chat.threads(shipped.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    turns = "".join(f"{'user' if i % 2 else 'assistant'}\nm{i}\n" for i in range(70))
    assert got[1].n_turns == 70 and got[1].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(f"m{i}" for i in range(0, 70, 2)).encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].n_turns == 2 and got[None].loss_chars == 1
    assert got[3].n_turns == 2 and got[3].loss_chars == 8
    assert got[4].turns_sha256 == hashlib.sha256(b"user\nfirst\nuser\nsecond\n").hexdigest()


def test_no_conversations(shipped):
    assert chat.format_chats(chat.threads(shipped.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(shipped, name):
    import duckdb

    c = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    relation = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](shipped, SF).collect()
    columns = relation.columns
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key([[r[x] for x in columns] for r in got]) == key(relation.fetchall())


def test_pipeline_stages_equal_brute_force(shipped):
    import public_tokenizers
    import tiktoken
    from test_text_operators import RANKS, brute_components, brute_line_dedup

    import corpus_pipeline as P
    from chatloom.llm.mixing import mix_sources, taken_words
    from chatloom.llm.prefix_bpe import PrefixCoder
    from chatloom.llm.toxicity import toxicity

    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    labels = shipped.read.parquet(f"{SF}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    stages, before = dict(P.STAGES), docs
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "prefix_bpe"]

    def texts(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    clean = stages["toxicity"](shipped, before, SF).cache()
    rejected = {r.doc_id for r in toxicity(docs, labels).filter("toxic").collect()}
    assert texts(clean) == {i: t for i, t in texts(docs).items() if i not in rejected}

    unique = stages["line_dedup"](shipped, clean, SF).cache()
    want = brute_line_dedup(shipped, sorted(texts(clean).items()), 25, 50)
    assert texts(unique) == {i: t for i, t in want.items() if t.strip() or t == texts(clean)[i]}

    apart = stages["near_dedup"](shipped, unique, SF).cache()
    roots = brute_components(sorted(texts(unique).items()), 5, 80)
    assert texts(apart) == {i: t for i, t in texts(unique).items() if roots[i] == i}

    mixed = stages["mixing"](shipped, apart, SF).cache()
    taken = {r.doc_id: r.taken for r in taken_words(mix_sources(apart)).collect() if r.taken}
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == taken

    out = stages["prefix_bpe"](shipped, mixed, SF).collect()
    with open(RANKS, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=PrefixCoder(f.read()).rank, special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in mixed.collect())
    assert all(s.columns == docs.columns for s in (clean, unique, apart, mixed))
    names = ("n_lines", "removed_lines", "row", "spans", "_tie", "cuts", "kept", "component_id", "a.b")
    for name, stage in P.STAGES:
        wide = docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string"))).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
        rows = stage(shipped, wide, SF).collect()
        assert stage(shipped, wide.limit(0), SF).count() == 0
        if name != "prefix_bpe":
            assert all(list(r)[-len(names) :] == list(range(len(names))) for r in rows) and rows[0].__fields__ == wide.columns
            assert name == "mixing" or sum(r.doc_id is None for r in rows) == 1
        else:
            assert len(rows) == wide.count()
    assert sorted((r.doc_id, r.ids_sha256) for r in P.run(shipped, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_pages_without_an_identifier_that_share_a_payload(shipped):
    """Each is a record of its own, whatever their urls, and they refer to the identified page if there is one."""
    rows = [(None, f"http://h/{i % 40}", "same") for i in range(120)] + [(None, None, "same")] * 3 + [(None, "http://h/1", "other")] * 2 + [(4, "u", "same"), (2, "u", "same")]
    got = warc.archived(shipped.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    same = [r for r in got if r.payload_bytes == 4]
    assert sorted((r.record_type, str(r.refers_to)) for r in same if r.page_id is None) == [("revisit", "4")] * 123
    assert sorted((r.page_id, r.record_type) for r in same if r.page_id) == [(2, "revisit"), (4, "response")]
    assert [r.record_type for r in got if r.payload_bytes == 5] == ["response"] * 2
