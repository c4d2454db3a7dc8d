"""Near-duplicate documents by Order MinHash and banded alignment.

Words are runs of word characters in lower case; a k-mer is five words with the number of its
occurrence in the text. Each of ``SKETCHES`` hash functions picks the ``PICKS`` k-mers with the
least hashes, and their tuple in text order is one key, so keys agree for texts that are similar
under edits and not merely in their sets of k-mers. In texts under ``SHORT`` words an edit or two
touches most five-word k-mers; they get as many keys of two-word k-mers besides.

Texts under one key are compared with a leader, the least of them. Where the others of a key are then
still in more than one class (unlike texts around a common passage or template), each of them is sketched again,
by the single words that it has beside its leader's: near copies share most of those and unlike texts hardly
any two of them. Under these keys texts meet the least one again. So the pairs compared grow with the rows,
whatever passages unlike texts share. Two texts are linked if the edit similarity of their words, 1 - distance / longer length, is at least
``SIMILARITY`` by banded alignment. Links are closed transitively.

Candidates are probable and not certain: the share of pairs that are compared is a function of their
similarity and is measured in the tests (README), with and without templates.

Exact copies meet first, by names of their texts that 128-bit digests have checked, so a group of
copies of any size is one node.

Defined cases: a null text counts as an empty one; texts without words are linked to equal texts
only; texts of one to four words have one k-mer; repeated rows share a class; a null id is in a
class like any other and never the class id unless all are null; clashing names are not carried;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from copy import copy

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.common import Names, Workspace, settings, tagged

K = 5
SKETCHES = 64
PICKS = 2
#: Texts, or pairs of them, in one Arrow batch at most.
BATCH_ROWS = 1000
#: Of them, those worked on at once.
SLICE_ROWS = 250
#: Texts of fewer words get keys of two-word k-mers besides.
SHORT, SHORT_K = 40, 2
SIMILARITY = 0.8
U = np.uint64
_WORDS = re.compile(r"\w+").findall
_ODD = np.random.default_rng(7).integers(1, 1 << 63, SKETCHES, dtype=U) * U(2) + U(1)
_SEED = np.random.default_rng(11).integers(0, 1 << 63, SKETCHES, dtype=U)


class _WordHash(dict):
    """Word to a stable 64-bit hash, forgotten as a whole when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHash()


def word_ids(text: str) -> np.ndarray:
    words = _WORDS(text.lower())
    return np.fromiter(map(_HASHES.__getitem__, words), U, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def kmers(ids: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in text order; of the whole text if it is shorter."""
    if not len(ids):
        return ids
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = ids[:n].astype(U)
    for i in range(1, k):
        h = h * U(0x9E3779B97F4A7C15) + ids[i : i + n].astype(U)
    return _mix(h + U(k))


def with_occurrence(h: np.ndarray) -> np.ndarray:
    """The k-mers labelled by how often they came before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return h
    new = np.concatenate(([True], s[1:] != s[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    occurrence = np.empty(len(h), np.int64)
    occurrence[order] = np.arange(len(s)) - start
    return np.where(occurrence > 0, _mix(h + occurrence.astype(U) * U(0xD6E8FEB86659FD93)), h)


def _sketch(h: np.ndarray, block: int) -> np.ndarray:
    if len(h) == 1:
        return _mix(h[0] + _SEED).view(np.int64)
    least = np.full((SKETCHES, 2 * PICKS), np.iinfo(U).max, U)
    place = np.full((SKETCHES, 2 * PICKS), len(h) - 1)
    rows = np.arange(SKETCHES)
    for s in range(0, len(h), block):  # long texts in blocks of bounded memory
        x = (h[None, s : s + block] ^ _SEED[:, None]) * _ODD[:, None]
        for c in range(PICKS):
            at = x.argmin(1)
            least[:, PICKS + c], place[:, PICKS + c] = x[rows, at], at + s
            x[rows, at] = np.iinfo(U).max
        if len(h) > block:
            order = np.argsort(least, axis=1, kind="stable")
            least, place = np.take_along_axis(least, order, 1), np.take_along_axis(place, order, 1)
            least[:, PICKS:] = np.iinfo(U).max
        else:
            place[:, :PICKS] = place[:, PICKS:]
    picked = np.sort(place[:, :PICKS], axis=1)
    key = np.zeros(SKETCHES, U)
    for c in range(PICKS):
        key = _mix(key * U(0x9E3779B97F4A7C15) + h[picked[:, c]])
    return (key + _SEED).view(np.int64)


def sketch(ids: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """One key for each hash function: its least k-mers in text order; twice as many for short texts."""
    if not len(ids):
        return np.zeros(0, np.int64)
    keys = _sketch(with_occurrence(kmers(ids)), block)
    if SHORT_K < len(ids) < SHORT:
        keys = np.concatenate((keys, _sketch(with_occurrence(kmers(ids, SHORT_K)), block)))
    return keys


def sketch_residue(ids: np.ndarray, leader: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """Keys of the words of a text that a leader's ``bag`` lacks, in text order; one key if it lacks none."""
    h = with_occurrence(_mix(ids.astype(U)))
    at = np.searchsorted(leader, h)
    at[at == len(leader)] = 0
    own = h[leader[at] != h] if len(leader) else h
    return _sketch(own, block) if len(own) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- verification


def _within_band(pairs: Sequence[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distances of many pairs at once along alignments that stay within ``width`` diagonals."""
    rows, span = len(pairs), 2 * width + 1
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    left = np.full((rows, n.max()), -1, np.int64)
    right = np.full((rows, n.max() + span + 1), -2, np.int64)
    for r, (a, b) in enumerate(pairs):
        left[r, : len(a)] = a
        stop = min(len(b), right.shape[1] - width)
        right[r, width : width + stop] = b[:stop]
    far = np.int32(1 << 29)
    step = np.arange(span, dtype=np.int32)
    now = np.broadcast_to(np.where(step >= width, step - width, far), (rows, span)).astype(np.int32)
    out = np.where(n == 0, m, far).astype(np.int32)
    for i in range(1, n.max() + 1):
        best = now + (left[:, i - 1 : i] != right[:, i - 1 : i - 1 + span])
        np.minimum(best[:, :-1], now[:, 1:] + 1, out=best[:, :-1])
        best -= step
        np.minimum.accumulate(best, axis=1, out=best)
        best += step
        if i <= width:
            best[:, : width - i] = far
        now = best
        ends = np.flatnonzero(n == i)
        if len(ends):
            column = m[ends] - i + width
            ok = (column >= 0) & (column < span)
            out[ends[ok]] = now[ends[ok], column[ok]]
    return out


def bag(ids: np.ndarray) -> np.ndarray:
    """The words of a text as a sorted set: the n-th occurrence of a word is an element of its own."""
    return np.sort(with_occurrence(_mix(ids.astype(U))))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two bags share."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Texts(dict):
    """Packed words to (ids, bag) of the texts met last; pairs come in order of one side."""

    def __missing__(self, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 300:
            self.clear()
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        known = self[packed] = ids, bag(ids)
        return known


def similar(pairs: Sequence[tuple[np.ndarray, np.ndarray]], at_least: float = SIMILARITY, cells: int = 4_000_000, bags: Sequence[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Whether each pair is similar. Bands grow only for pairs that a narrower one leaves open. ``bags`` of the pairs, if known."""
    out = np.zeros(len(pairs), bool)
    longer = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    limit = np.floor((1 - at_least) * longer + 1e-9).astype(np.int64)
    open_ = []
    for k, (a, b) in enumerate(pairs):
        # the words that differ place by place are edits enough; those that have no partner cost one edit each
        if len(a) == len(b) and np.count_nonzero(a != b) <= limit[k]:
            out[k] = True
            continue
        if abs(len(a) - len(b)) <= limit[k] and longer[k] - _common(*(bags[k] if bags else (bag(a), bag(b)))) <= limit[k]:
            open_.append(k)
    width = 12
    while open_:
        open_.sort(key=lambda k: len(pairs[k][0]))
        left = []
        at = 0
        while at < len(open_):
            stop = at + 1
            while stop < len(open_) and (stop + 1 - at) * (len(pairs[open_[stop]][0]) + 2 * width) <= cells // 8 and (stop + 1 - at) * (2 * width + 1) <= 40_000:
                stop += 1
            group = open_[at:stop]
            distance = _within_band([pairs[k] for k in group], width)
            for k, d in zip(group, distance.tolist(), strict=True):
                if d <= limit[k]:
                    out[k] = True
                elif width < limit[k]:
                    left.append(k)
            at = stop
        open_, width = left, width * 4
    return out


# ---------------------------------------------------------------- links to classes


def components(links: DataFrame, space: Workspace, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node it is connected to.

    Alternates large-star and small-star steps; every round is written to the shared folder.
    """
    edges = space.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: greater neighbours move to the least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = space.save(edges, "large")
        # small star: the node and its smaller neighbours move to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = space.save(edges, "small")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if now == before or now[0] == now[2] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


_SKETCHED = T.StructType([T.StructField("node", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


class _Keyed:
    """Names of the texts (node) and of the rows by id and text (row) of one table."""

    def __init__(self, docs: DataFrame, text: str, space: Workspace) -> None:
        self.body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        self.nodes = Names(docs.select(self.body.alias("c")), space)
        self.row = F.concat(tagged(F.col("doc_id")), F.col("_node").cast("string"))
        self.rows = Names(self.nodes.add(docs.select("doc_id", self.body.alias("_body")), F.col("_body"), "_node").select(self.row.alias("c")), space)

    def of(self, text: str) -> _Keyed:
        """The same names, read from a text column of another name."""
        other = copy(self)
        other.body = F.coalesce(F.col(text).cast("string"), F.lit(""))
        return other

    def add(self, docs: DataFrame) -> DataFrame:
        """``docs`` with _body, _node and _row."""
        return self.rows.add(self.nodes.add(docs.withColumn("_body", self.body), F.col("_body"), "_node"), self.row, "_row")


def sketch_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and keys of every text (node, row, text), each once."""
    for b in batches:
        for s in range(0, b.num_rows, SLICE_ROWS):
            part = b.slice(s, SLICE_ROWS)
            ids = [word_ids(t) for t in part.column("text").to_pylist()]
            keys = [sketch(i) for i in ids]
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("row"), pa.array(list(map(len, ids)), pa.int32()), lists], names=["node", "row", "n", "keys"])


def near_links(keyed: DataFrame, space: Workspace) -> DataFrame:
    """(a, b): verified links between nodes of ``keyed`` (node, row, text)."""
    with settings(keyed.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=str(BATCH_ROWS)):
        return _near_links(keyed, space)


def _near_links(keyed: DataFrame, space: Workspace) -> DataFrame:
    nodes = space.save(keyed.mapInArrow(sketch_all, _SKETCHED).dropDuplicates(["node"]), "nodes")
    members = nodes.select("node", "n", F.posexplode("keys").alias("j", "value")).select("node", "n", F.xxhash64("j", "value").alias("key"))
    # the first leader of a key is its least node: like texts share most keys and so meet the same one
    heads = members.groupBy("key").agg(F.min("node").alias("leader"), F.min_by("n", "node").alias("leader_n"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # every other member of a shared key with its leader; most keys are shared by two texts and end here
    hits = space.save(members.join(heads.hint("merge"), "key").filter("node <> leader"), "hits")
    # words of those texts only
    met = hits.select("node").unionByName(hits.select(F.col("leader").alias("node"))).distinct()
    wanted = space.save(nodes.join(met.hint("merge"), "node", "left_semi").select("row"), "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_ids(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(words, pa.binary())], names=["node", "words"])

    words = space.save(keyed.join(wanted.hint("merge"), "row").select("node", "text").mapInArrow(pack, "node bigint, words binary").dropDuplicates(["node"]), "words")
    space.release()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(s, SLICE_ROWS)
                known = [(texts[x], texts[y]) for x, y in zip(part.column("words_a").to_pylist(), part.column("words_b").to_pylist(), strict=True)]
                good = pa.array(similar([(x[0], y[0]) for x, y in known], bags=[(x[1], y[1]) for x, y in known]))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose words align."""
        half = space.save(pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")).hint("merge"), "a"), "half")
        both = half.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")).hint("merge"), "b").select("a", "b", "words_a", "words_b")
        found = space.save(both.mapInArrow(verify, "a bigint, b bigint"), "links")
        space.drop("*-half")
        space.release()
        return found

    # texts whose lengths differ by more than the edits allowed cannot be linked
    alike = F.least("n", "leader_n") >= F.lit(SIMILARITY) * F.greatest("n", "leader_n") - 1e-6
    pair = [F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")]
    tried = space.save(hits.filter(alike).select(*pair).distinct(), "pairs")
    links = verified(tried)
    rest = hits.filter("c > 2").select("key", "leader", "node", "n")

    def still_open(rest: DataFrame) -> DataFrame:
        """``rest`` with root, without the keys whose members are in one class."""
        rest = rest.join(components(links, space), "node", "left").select("key", "leader", "node", "n", F.coalesce("root", "node").alias("root"))
        rest = space.save(rest, "rest")
        open_ = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        return space.save(rest.join(open_.hint("merge"), "key"), "left")

    # second round: what a member has beside the words of its leader, sketched by itself
    left = still_open(rest)
    if left.isEmpty():
        return links

    def sketch_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _Texts()
        for b in batches:
            for s in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(s, SLICE_ROWS)
                keys = [sketch_residue(np.frombuffer(x, "<u4").astype(np.int64), texts[y][1]) for x, y in zip(part.column("words_a").to_pylist(), part.column("words_b").to_pylist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("leader", "node", "n", "root")], lists], names=["leader", "node", "n", "root", "keys"])

    led = space.save(left.select("leader", "node", "n", "root").distinct(), "led")
    half = space.save(led.join(words.select("node", F.col("words").alias("words_a")).hint("merge"), "node"), "half")
    both = half.join(words.select(F.col("node").alias("leader"), F.col("words").alias("words_b")).hint("merge"), "leader").select("leader", "node", "n", "root", "words_a", "words_b")
    residue = space.save(both.mapInArrow(sketch_rest, "leader bigint, node bigint, n int, root bigint, keys array<bigint>"), "residue")
    space.drop("*-half")
    space.release()
    fine = residue.select("leader", "node", "n", "root", F.posexplode("keys").alias("j", "value")).select("node", "n", "root", F.xxhash64("leader", "j", "value").alias("key"))
    heads = fine.groupBy("key").agg(F.min("node").alias("leader"), F.min_by("n", "node").alias("leader_n"), F.min_by("root", "node").alias("leader_root"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    pairs = fine.join(heads.hint("merge"), "key").filter("root <> leader_root").filter(alike).select(*pair).distinct()
    return links.unionByName(verified(space.save(pairs.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")))


def _classes(docs: DataFrame, text: str, names: _Keyed, space: Workspace) -> DataFrame:
    keyed = names.add(docs.select("doc_id", text)).select("doc_id", F.col("_node").alias("node"), F.col("_row").alias("row"), F.col("_body").alias("text"))
    links = near_links(keyed.drop("doc_id"), space)
    roots = components(links, space)
    rows = space.save(keyed.drop("text").join(roots, "node", "left").select("doc_id", "node", "row", F.coalesce("root", "node").alias("root")), "rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("row"))).alias("null_row"), F.count(F.lit(1)).alias("class_rows"))
    texts = rows.groupBy("root", "node").agg(F.lit(1)).groupBy("root").agg(F.count(F.lit(1)).alias("class_texts"))
    least = space.save(least.join(texts, "root"), "least")
    return rows.join(least, "root")


def near_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of the class), class_rows, class_texts (different ones) and n_links.

    Links are closed within a class, so a text is linked to all its other texts: n_links is class_texts - 1.
    node names the text, row the id and text, root the class, null_row a row of a class without other ids.
    """
    space = Workspace(docs.sparkSession, "minhash")
    out = _classes(docs, text, _Keyed(docs, text, space), space)
    return out.select("doc_id", "node", "row", "class_id", "class_rows", "class_texts", (F.col("class_texts") - 1).alias("n_links"), "null_row", "root")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of every class: the least id (among equal ids the least row hash)."""
    space = Workspace(docs.sparkSession, "keepone")
    names = _Keyed(docs, text, space)
    classes = _classes(docs, text, names, space)
    chosen = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("row"))
    chosen = space.save(chosen.select(F.col("row").alias("_row")), "chosen")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_docs"), "doc_id", F.col(text).alias("_text"))
    kept = names.of("_text").add(own).join(chosen.hint("merge"), "_row").select("_docs", "_row")
    # rows that agree in id and text share a name: one of them stays
    several = space.save(classes.groupBy("row").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("row").alias("_row")), "several")
    one = kept.join(several, "_row", "left_anti").select("_docs.*")
    again = kept.join(several, "_row", "left_semi").groupBy("_row").agg(F.min_by("_docs", F.xxhash64("_docs")).alias("_docs"))
    return one.unionByName(again.select("_docs.*"))
