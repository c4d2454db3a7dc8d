import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import filter_audit, packing, registry, spelling, sql

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)


# --- spelling


def brute_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_variants(words):
    near = defaultdict(list)
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form[w] or "", words[form[w]] if form[w] else -1, root(w)) for w, n in words.items())


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in df.collect())


def test_variants_match_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("abé")
    stems = ["".join(rng.choice(letters, int(rng.integers(6, 10)))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaa", "abababab", "bababab", "Àbcdef", "àbcdef"]
    texts = []
    for s in stems:
        texts += [s] * int(rng.choice([5, 30, 200]))
        for _ in range(6):  # edits at every place, ends too
            i, c = int(rng.integers(0, len(s) + 1)), str(rng.choice(letters))
            v = [s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]][int(rng.integers(3))]
            texts += [v] * int(rng.choice([5, 6, 25]))
    rows = [(i, f"{t}, {t.upper() if i % 7 == 0 else t}") for i, t in enumerate(texts)]
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute_variants(brute_words(rows))
    assert any(r[3] for r in got) and max(r[2] for r in got) > 3


def test_a_chain_of_forms_ends_at_its_root(spark):
    """Nine words, each an edit from the next and five times rarer, and a tie between two forms."""
    words = [("abcdef" + "ghijklmno"[:i], 5 ** (i + 1)) for i in range(9)] + [("tiefrm", 5), ("tiefra", 25), ("tiefrb", 25)]
    df = spark.createDataFrame(words, "word string, n bigint")
    near = spelling.near_words(df).groupBy("word", "n").agg(F.min(F.struct(-F.col("near_n"), F.col("near").alias("near"))).alias("b"))
    got = {r.word: r.root for r in spelling.roots(near.filter("-b.col1 >= 5 * n").select("word", F.col("b.near").alias("form")), spelling.Workspace(spark, "t")).collect()}
    assert got["abcdef"] == "abcdefghijklmn" and got["tiefrm"] == "tiefra"
    assert len(got) == 9


def test_a_shared_rare_bigram_makes_no_large_group(spark):
    """Words that all start with the same rare bigram do not meet: candidates stay in proportion to the words."""
    rng = np.random.default_rng(1)
    words = sorted({"qz" + "".join(rng.choice(list("abcdefghijklmnop"), 8)) for _ in range(3000)})
    keys = spelling.join_keys(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint"))
    sizes = keys.groupBy("key").agg(F.countDistinct("word").alias("n"))
    assert sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] < 40 * len(words)


def test_no_keys_are_broadcast(spark, tmp_path):
    """The words' file is small enough for Spark to broadcast it, the keys made of it are not."""
    spark.createDataFrame([("wordy", 5), ("words", 9)], "word string, n bigint").write.parquet(f"{tmp_path}/words")
    near = spelling.near_words(spark.read.parquet(f"{tmp_path}/words"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.word, r.near) for r in near.collect()) == [("words", "wordy"), ("wordy", "words")]


def test_variants_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(spelling.variants(odd)) == brute_variants(brute_words(rows))
    assert spelling.variants(nothing).count() == 0
    long = spark.createDataFrame([(1, "y" * 3000 + " ")] * 6 + [(1, "y" * 2999 + "z")] * 40, "doc_id bigint, text string")
    assert sorted(found(spelling.variants(long))) == brute_variants(brute_words([(1, "y" * 3000)] * 6 + [(1, "y" * 2999 + "z")] * 40))


# --- packing


def check_packed(packed, rows):
    """Every id of every document in one piece, sequences gapless and without padding."""
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter((d, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in rows)
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and 1 <= r.length <= 2048 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))
    assert [r.length for r in sorted(packed, key=lambda r: r.sequence_id)] == sorted((r.length for r in packed), reverse=True)
    got = Counter()
    for d, pieces in by_doc.items():
        copies = Counter((r.start, r.length, r.doc_tokens, tuple(r.ids)) for r in pieces)
        for (start, _, tokens, _), n in sorted(copies.items(), key=lambda x: x[0][0]):
            if start == 0 and tokens == 1:
                got[d, (1,)] += n
        wanted = [(k, n) for k, n in want.items() if k[0] == d]
        made = Counter()
        for (_, ids), n in wanted:
            start = 0
            for length in packing.piece_lengths(len(ids)):
                made[start, length, len(ids), ids[start : start + length]] += n
                start += length
        assert copies == made
    assert {k[0] for k in want} == set(by_doc)


def test_packed_ids_are_the_tokenizers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    check_packed(packing.pack(docs, VOCABULARY).collect(), [tuple(r) for r in docs.collect()])


def test_packing_of_odd_rows(spark, odd, nothing, tmp_path):
    strange = ["It's we'LL é é ẛ̣", "a b c\x1cd\x85e", "ΣΑΣ İstanbul ǅ", "́ lead 9½ ²", "<|endoftext|> x", "'s 't", "﻿bom", "日本語テキスト 😀😀"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(strange)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    check_packed(packing.pack(docs, VOCABULARY).collect(), [tuple(r) for r in docs.collect()])
    assert packing.pack(odd, VOCABULARY).count() == packing.pack(odd.select("doc_id", "text"), VOCABULARY).count()
    assert packing.pack(nothing, VOCABULARY).count() == 0
    packing.write_buckets(packing.pack(more, VOCABULARY), f"file://{tmp_path}/buckets")
    read = spark.read.parquet(f"file://{tmp_path}/buckets")
    assert read.filter(F.size("ids") != F.col("length")).count() == 0 and read.count() > len(strange)


def test_words_forgotten_are_encoded_again():
    few = packing.WordEncoder(VOCABULARY, known=9)
    few._learn_pieces(["two 0 words", "one", "0"])  # not what the library splits off: each by itself
    assert few.ids["two 0 words"] == few.encode(["two 0 words"])[0]
    many = packing.WordEncoder(VOCABULARY)
    texts = [" ".join(f"w{i % 7} x{i}" for i in range(j)) for j in range(12)]
    assert [few.encode([t])[0] for t in texts] == many.encode(texts)
    assert len(few.ids) <= 30 and len(few.older) <= 30


def test_plain_characters_split_as_the_library_does():
    """Every plain character beside letters, digits, marks, white space and apostrophes."""
    library, own = Tokenizer.from_file(VOCABULARY), packing.WordEncoder(VOCABULARY)
    plain = [chr(c) for c in range(0x2100) if packing.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 190
    texts = [t for c in plain for t in (f"a{c}b", f"{c}{c}1{c}", f".{c}'{c}s {c}", f"É{c}ß'll{c}")]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice([*plain, "'", "s", "t", " ", "7"], 30)) for _ in range(2000)]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_lengths_add_up():
    for n in range(1, 5000):
        made = packing.piece_lengths(n)
        assert sum(made) == n and made == sorted(made, reverse=True)
    with pytest.raises(ValueError):
        packing.cut(None, VOCABULARY, longest=100)


# --- filter audit


def brute_audit(rows, labels):
    """Each order run step by step over the rows."""
    least, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))

    def fails(d, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        return out + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (d is not None and d > least[t])

    parts = defaultdict(list)
    for d, t, p in rows:
        parts[p or ""].append((d, fails(d, t)))
    out = []
    for p, docs in parts.items():
        steps, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for k, x in enumerate(order, 1):
                gone = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(gone)
                redundant = sum(x in f for _, f in docs) - len(gone)
                steps.append((p, order, k, len(left), len(gone), redundant, sum(f == x for _, f in docs), sum(d in good for d in gone), sum(d in toxic for d in gone), x))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit_matches_every_order_run_by_itself(spark):
    rng = np.random.default_rng(2)
    texts = ["Aa " * 5, "a b c", "", None, "x # y", " ".join(f"w{i}" for i in range(220)), "W " * 250, "É" * 9]
    rows = [(int(rng.integers(40)), texts[int(rng.integers(8))], [None, "", "s", "t"][int(rng.integers(4))]) for _ in range(120)] + [(None, "a b c", "s"), (None, None, None), (None, "only here", "t")]
    labels = [(i, [0, 1, None][i % 3], [1, 0, None, 0][i % 4]) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    named = [x for x in labels if x[0] is not None]
    assert audited(got) == brute_audit(rows, named)


def test_audit_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(2, 1, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert audited(filter_audit.audit(odd, labels)) == brute_audit(rows, [(2, 1, 0), (9, 0, 1)])
    assert filter_audit.audit(nothing, labels).count() == 0
    assert len(audited(filter_audit.audit(odd, labels.limit(0)))) == 600 * 4


def test_zeta_sums_subsets(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    row = spark.range(1).select(filter_audit.subset_zeta(F.array(*[F.lit(v).cast("bigint") for v in values]), 3).alias("z")).first()
    assert row.z == [sum(v for i, v in enumerate(values) if i & ~m == 0) for m in range(8)]
    assert sql.OP13 and filter_audit.COPIES == "E"
