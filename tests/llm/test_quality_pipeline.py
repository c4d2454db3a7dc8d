import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from lodestone.llm import bpe, registry, sql
from lodestone.llm import knn_quality as kq
from lodestone.llm.common import SPACE_CHARS


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        w = ["".join(rng.choices("etaoins", k=rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        kind = i % 5
        text = " ".join(w) + "." if kind else rng.choice([" ".join(x + "***" for x in w), " ".join(w).upper().replace(" ", "!! "), " ".join([w[0]] * 60)])
        rows.append((i, text))
        labels.append((i, 1 if kind else 0, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (7, 5, 0)], "doc_id bigint, quality int, toxic int")
    out = kq.score(docs, kq.train(docs, known)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.95 * len(held)


def test_scores_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (7, 1), (8, 0), (10, 0), (11, 0), (99, 1)], "doc_id bigint, quality int")
    model = kq.train(odd, labels)
    assert kq.score(odd, model).count() == odd.count()
    assert kq.score(nothing, model).count() == 0
    untaught = kq.train(odd, labels.limit(0))
    assert {r.score for r in kq.score(odd, untaught).collect()} == {0.5}


def edit_distance(a, b):
    """By whole rows of the table, without a band."""
    names = {w: i for i, w in enumerate({*a, *b})}
    x, y = (np.array([names[w] for w in t]) for t in (a, b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, w in enumerate(x, 1):
        new = np.minimum(np.concatenate(([i], row[:-1] + (y != w))), np.concatenate(([i], row[1:] + 1)))
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


def test_votes_match_brute_force(spark):
    """Scores against cosines of every labelled row computed one by one."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcdef" if i % 3 else "wxyz!", k=rng.randint(2, 6))) for _ in range(rng.randint(5, 40)))) for i in range(160)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    model = kq.train(docs, labels)
    texts = dict([*rows, (900, "")])
    for r in kq.score(docs, model).collect():
        z = (kq.term_counts(texts.get(r.doc_id, "").encode()) - model.mean) @ model.basis
        z = z / max(float(np.sqrt(sum(float(c) ** 2 for c in z))), 1e-9)
        near = sorted(((sum(float(a) * float(b) for a, b in zip(z, v, strict=True)), k) for k, v in enumerate(model.vectors)), reverse=True)[: kq.NEIGHBOURS]
        votes = [((min(1.0, max(0.0, c)) ** 8 + 1e-6) * model.weights[k], model.labels[k]) for c, k in near]
        want = sum(w * y for w, y in votes) / sum(w for w, _ in votes)
        assert abs(r.score - want) < 1e-3, (r.doc_id, r.score, want)


def brute_pipeline(sf):
    """The pipeline without Spark: SQL for rules and mixing, all pairs, all strings, a reference tokenizer."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.OP2}) WHERE kept").fetchall()}
    docs = [r for r in con.sql("SELECT doc_id, text, source FROM documents").fetchall() if r[0] in kept]
    root = {r[0]: r[0] for r in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    split = [re.findall(r"\w+", (r[1] or "").lower()) for r in docs]
    bags = [Counter(w) for w in split]
    for i in range(len(docs)):
        for j in range(i):
            longest = max(len(split[i]), len(split[j]))
            same = docs[i][1] == docs[j][1]
            if not same and longest and min(len(split[i]), len(split[j])) >= 0.8 * longest and sum((bags[i] & bags[j]).values()) >= 0.8 * longest:
                same = edit_distance(split[i], split[j]) <= 0.2 * longest + 1e-9
            if same:
                a, b = find(docs[i][0]), find(docs[j][0])
                root[max(a, b)] = min(a, b)
    docs = [r for r in docs if find(r[0]) == r[0]]
    raw = [(r[1] or "").encode() for r in docs]
    count = Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    left = []
    for t in raw:
        cover = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                cover[p : p + 200] = b"\1" * 200
        # a character goes with any of its bytes
        at, kept = 0, []
        for c in t.decode():
            n = len(c.encode())
            if not any(cover[at : at + n]):
                kept.append(c)
            at += n
        left.append("".join(kept))
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], t, r[2]) for r, t in zip(docs, left, strict=True)])
    mixed = con.sql(f"SELECT m.doc_id, taken // size, text FROM ({sql.OP9}) m JOIN documents d ON d.doc_id = m.doc_id WHERE size > 0").fetchall()
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, times, text in mixed:
        tokens = reference.encode_ordinary(text)
        out += [(i, len(tokens), hashlib.sha256(struct.pack(f"<{len(tokens)}I", *tokens)).hexdigest())] * times
    return sorted(out)


def test_pipeline_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, before, sf)
        assert out.columns == docs.columns, name
        before = out.cache()
    assert [r.ids for r in cp.STAGES[-1][1](spark, before, sf).limit(1).collect()][0]
    worded = {r.doc_id for r in before.collect() if r.text.strip(SPACE_CHARS)}
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in cp.run(spark, sf).collect() if r.doc_id in worded)
    assert got == brute_pipeline(sf)


def test_every_query_runs(spark):
    sf = "/root/testdata/sf0.001"
    for name, query in registry.queries().items():
        if name != "pipeline":
            assert query(spark, sf).count() > 0, name


def test_stages_carry_odd_rows(spark, odd, nothing):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables in every stage."""
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, name
        for r in out.collect():
            assert r.n_words == 7 and r.kept == 7 and r.score == 7 and r.failed_rule == 7, name
        assert stage(spark, nothing, "").count() == 0, name
    last = cp.STAGES[-1][1](spark, odd, "")
    assert last.count() == odd.count() and cp.STAGES[-1][1](spark, nothing, "").count() == 0
    kept = {r.doc_id for r in cp.quality_stage(spark, odd, "").collect()}
    assert {1, 2, 3} <= kept and not kept & {4, 5, 6, 7, 11}  # 7 repeats itself
