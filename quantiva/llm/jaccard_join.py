"""Exact n-gram Jaccard join with set-relation skipping, down to groups of linked documents.

Documents are sets of word shingles.  Equal sets are one class; the join is
between classes:

1. Index.  Shingles are ordered by rarity: by their count or that of their
   rarest word, whichever is less (in fixed-size sketches over all documents),
   then the hash; two sets that link share one of the first n - ceil(t n) + 1
   shingles of either, its prefix.  Prefix shingles that two classes or more
   have make up the inverted lists; one that occurs once anywhere needs none.
2. Leaders.  Every class is compared with the leader of each of its lists: the
   class that has the shingle at the smallest position, so has the fewest
   rare shingles of its own and is the likely origin of the others.  For close pairs the differences from the leader are kept.
   Linked classes form first groups.
3. Lists.  What remains are pairs of different groups.  Lists are cut into
   blocks by length and prefix position; a pair of blocks is skipped as a
   whole if lengths, positions or groups rule out every pair.  Pairs that
   remain are bounded by histograms of their shingles, derived from their
   differences to a common leader where there is one (the answer of a very
   similar set is already known), and otherwise counted on the sets.

A list whose classes are all in one group gives no pairs at all, so a large
set of near copies costs one comparison a copy instead of all pairs.  No link
between different groups is missed: the result does not depend on the sketch,
the leaders or the blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, pack, stored, text_column, unpack
from .components import components
from .words import Hasher, blank_separators, ngrams

SKETCH_BITS = 22
SLICE_BITS = 16
BITMAP_BITS = 23
HISTOGRAM = 128
BLOCK = 256          # entries of a block of an inverted list, about
_U = np.uint64


def row_key(id_col: str, text_col: str):
    """Hash of a row's id and text (null text: empty)."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, hasher: Hasher, n: int, rank: np.ndarray | None = None):
    """(row, sorted distinct shingle hashes, their ranks) of each text; a text of fewer words is one shingle,
    without words none.  The rank of a shingle is the least of its own and its words' in the sketches ``rank``."""
    for lo, hi, bounds, h in hasher.words(raw, offsets):
        word_rank = None if rank is None else rank[0][h >> _U(64 - SKETCH_BITS)]
        for k in range(hi - lo):
            a, b = bounds[k], bounds[k + 1]
            size = min(n, b - a)
            if not size:
                yield lo + k, h[a:a], None
                continue
            s = ngrams(h[a:b], size)
            if size < n:
                s = s ^ _U(size)
            r = None
            if rank is not None:
                r = np.minimum(rank[1][s >> _U(64 - SKETCH_BITS)], word_rank[a:a + len(s)])
                for j in range(1, size):
                    r = np.minimum(r, word_rank[a + j:a + j + len(s)])
                order = np.argsort(s)
                s, r = s[order], r[order]
            else:
                s = np.sort(s)
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield lo + k, s[keep], None if r is None else r[keep]


def class_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def rarity(texts: DataFrame, n: int) -> np.ndarray:
    """Two sketches [2, cells]: for each cell (top bits of a hash) the bit length of the count of its words, and of
    its n-word shingles, over all texts.  It is at least that of any of them, so one of rank 1 occurs once."""

    def count(batches):
        hasher = Hasher(blank_separators())
        cells = np.zeros(2 << SKETCH_BITS, np.int32)
        for b in batches:
            for _, _, _, h in hasher.words(*text_column(b, "text")):
                # shingles over the end of a text count too: the counts only need to be large enough
                for base, own in ((0, h), (1 << SKETCH_BITS, ngrams(h, n))):
                    at, k = np.unique((own >> _U(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
                    at += base
                    cells[at] = np.minimum(cells[at] + k, 1 << 30)
        size = 1 << SLICE_BITS
        for k in range(len(cells) // size):
            own = cells[k * size:(k + 1) * size]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(own)], pa.binary())], ["slice", "counts"])

    def add(key, table):
        total = sum(unpack(x.as_py()) for x in table.column("counts"))
        rank = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pack(rank)], pa.binary())], ["slice", "ranks"])

    rows = texts.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(
        add, "slice int, ranks binary").collect()  # the sketch: fixed size
    out = np.zeros(2 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r["slice"] << SLICE_BITS: (r["slice"] + 1) << SLICE_BITS] = unpack(r["ranks"])
    return out.reshape(2, -1)


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def document_sets(rows: DataFrame, n: int, percent: int, ranks) -> DataFrame:
    """doc_id, row_key, c (class), n_shingles, tokens and positions of the prefix (but for shingles that no
    other text can have), histogram; one row per document.  A task gives tokens and histogram of a class once,
    with the first of the copies that it reads."""
    key = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        hasher, sent = Hasher(blank_separators()), set()
        rank = ranks.value
        for b in batches:
            out = [None] * b.num_rows
            for k, s, r in shingle_sets(*text_column(b, "text"), hasher, n, rank):
                if not len(s):
                    out[k] = (None, 0, None, None, None)
                    continue
                key = class_key(s)
                if key in sent:
                    out[k] = (key, len(s), None, None, None)
                    continue
                sent.add(key)
                first = np.argsort(r, kind="stable")[: prefix_length(len(s), percent)]  # s is sorted: ties by hash
                pos = np.flatnonzero(r[first] > 1)
                h = np.bincount((s >> _U(7) & _U(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM)
                hist = h.astype("<u2").tobytes() if h.max() < 1 << 16 else None
                out[k] = (key, len(s), s[first[pos]].view(np.int64), pos.astype(np.int32), hist)
            c, size, tokens, pos, hist = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(c, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(tokens, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(hist, pa.binary())],
                ["doc_id", "row_key", "c", "n_shingles", "tokens", "positions", "histogram"])

    return rows.mapInArrow(run, f"doc_id {key}, row_key bigint, c bigint, n_shingles bigint, tokens array<bigint>, "
                                "positions array<int>, histogram binary")


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Fixed-size bitmap of the top bits of 64-bit keys."""
    cell = F.shiftrightunsigned(F.col(column), 64 - BITMAP_BITS)
    words = ids.select(F.shiftright(cell, 6).alias("w"), F.expr("1L").alias("one"), (cell % 64).cast("int").alias("s"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, s)")).alias("bits"))
    table = words.toArrow()  # at most 2 ** (BITMAP_BITS - 6) rows
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    return out.view(_U)


def sets_of(rows: DataFrame, n: int, ids: DataFrame) -> DataFrame:
    """c, shingles (packed) of the classes in ``ids`` (c), built anew from the texts."""
    wanted = rows.sparkSession.sparkContext.broadcast(bitmap(ids, "c"))

    def run(batches):
        hasher, sent = Hasher(blank_separators()), set()
        bits = wanted.value
        for b in batches:
            c, packed = [], []
            for _, s, _ in shingle_sets(*text_column(b, "text"), hasher, n):
                if len(s):
                    key = class_key(s)
                    cell = (key & (1 << 64) - 1) >> (64 - BITMAP_BITS)
                    if key not in sent and int(bits[cell >> 6]) >> (cell & 63) & 1:
                        sent.add(key)  # a task sends a class once, however many copies it reads
                        c.append(key)
                        packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(packed, pa.binary())], ["c", "shingles"])

    found = rows.select("text").mapInArrow(run, "c bigint, shingles binary")
    return found.join(ids, "c", "left_semi").groupBy("c").agg(F.first("shingles").alias("shingles"))


def enough(common, n1, n2, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return common * (100 + percent) >= (n1 + n2) * percent


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose lengths and histograms allow a link, with na and nb."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n_shingles").alias(f"n{x}"),
                                    F.col("histogram").alias(f"h{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

    def run(batches):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            both = np.flatnonzero(b.column("ha").is_valid().to_numpy(False) & b.column("hb").is_valid().to_numpy(False))
            if len(both):
                some = b.take(pa.array(both))
                h = [text_column(some, c)[0].view("<u2").reshape(-1, HISTOGRAM) for c in ("ha", "hb")]
                most = np.minimum(h[0], h[1]).sum(axis=1, dtype=np.int64)
                ok[both] = enough(most, some.column("na").to_numpy(), some.column("nb").to_numpy(), percent)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return joined.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def counted(pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
    """a, b, na, nb, common and, if asked for, the shingles of a alone and of b alone (for pairs that have
    more than half of their shingles in common)."""
    side = lambda x: sets.select(F.col("c").alias(x), F.col("shingles").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    schema = "a bigint, b bigint, na bigint, nb bigint, common bigint" + ", only_a array<bigint>, only_b array<bigint>" * differences

    def run(batches):
        for b in batches:
            common, left, right = [], [], []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = y[at] == x
                k = int(both.sum())
                common.append(k)
                if differences:
                    near = 2 * k > max(len(x), len(y))
                    rest = np.ones(len(y), bool)
                    rest[at[both]] = False
                    left.append(x[~both].view(np.int64) if near else None)
                    right.append(y[rest].view(np.int64) if near else None)
            cols = [b.column(c) for c in ("a", "b", "na", "nb")] + [pa.array(common, pa.int64())]
            if differences:
                cols += [pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "na", "nb", "common"] + ["only_a", "only_b"] * differences)

    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, schema)


def list_pairs(postings: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different groups that share a prefix shingle and may link by length and position."""
    grouped = postings.join(groups.withColumnsRenamed({"node": "c", "root": "g"}), "c", "left").select(
        "token", "c", "n", "pos", F.coalesce("g", "c").alias("g"))
    sizes = grouped.groupBy("token", "g").agg(F.count("*").alias("k"))
    major = sizes.groupBy("token").agg(F.max(F.struct("k", "g")).alias("most"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    major = stored(major.filter("lo != hi").select("token", F.col("most.g").alias("major")), "lists")
    # entries of lists with more than one group, in blocks by length class and position class
    step = float(np.log(100 / percent))
    entries = grouped.join(major, "token").select(
        "token", (F.col("g") != F.col("major")).alias("minor"), F.floor(F.log(F.col("n").cast("double")) / step).alias("lc"),
        F.floor(8 * F.col("pos") / prefix_length_column(F.col("n"), percent)).alias("pc"), F.struct("c", "n", "pos", "g").alias("e"))
    entries = stored(entries, "entries")
    by = ["token", "minor", "lc", "pc"]
    crowded = entries.groupBy(*by).agg(F.count("*").alias("k")).filter(F.col("k") > BLOCK)
    salted = entries.join(crowded, by, "left").withColumn(
        "salt", F.pmod(F.xxhash64("e.c"), F.coalesce(F.ceil(F.col("k") / BLOCK), F.lit(1))))
    blocks = salted.groupBy(*by, "salt").agg(
        F.collect_list("e").alias("es"), F.min("e.n").alias("least"), F.max("e.n").alias("most"),
        F.max(F.col("e.n") - F.col("e.pos")).alias("rest"), F.min("e.g").alias("g0"), F.max("e.g").alias("g1"), F.max("e.c").alias("c1"))
    blocks = stored(blocks.drop("lc", "pc", "salt"), "blocks")
    discard(major, entries)
    x = blocks.filter("minor").select([F.col(c).alias(c if c == "token" else f"x_{c}") for c in blocks.columns])
    y = blocks.select([F.col(c).alias(c if c == "token" else f"y_{c}") for c in blocks.columns])
    # whole blocks are skipped: lengths out of reach, too few shingles left after the positions, or one group
    need = _least_common(F.greatest("x_least", F.ceil(F.col("y_least") * percent / 100)),
                         F.greatest("y_least", F.ceil(F.col("x_least") * percent / 100)), percent)
    met = x.join(y, "token").filter(
        (F.col("x_most") * 100 >= F.col("y_least") * percent) & (F.col("y_most") * 100 >= F.col("x_least") * percent)
        & (F.least("x_rest", "y_rest") >= need)
        & ~((F.col("x_g0") == F.col("x_g1")) & (F.col("y_g0") == F.col("y_g1")) & (F.col("x_g0") == F.col("y_g0"))))
    p = met.select("y_minor", "y_es", F.explode("x_es").alias("p"))
    may = lambda q: ((F.col("p.g") != q["g"]) & (~F.col("y_minor") | (F.col("p.c") < q["c"]))
                     & (F.col("p.n") * 100 >= q["n"] * percent) & (q["n"] * 100 >= F.col("p.n") * percent)
                     & (F.least(F.col("p.n") - F.col("p.pos"), q["n"] - q["pos"]) >= _least_common(F.col("p.n"), q["n"], percent)))
    q = p.select("p", F.explode(F.filter("y_es", may)).alias("q"))
    return q.select(F.least("p.c", "q.c").alias("a"), F.greatest("p.c", "q.c").alias("b")).distinct()


def prefix_length_column(n, percent: int):
    return n - F.ceil(n * percent / 100) + 1


def _least_common(n1, n2, percent: int):
    """Shingles that two sets of these sizes must share to link."""
    return F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, class_id, component_id, component_size, component_key; one row per input row.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, a document's set holds its distinct n-word
    shingles (the whole sequence, if it has fewer words).  Two documents link when 100 times the
    common shingles are at least ``percent`` times the union.  component_id is the smallest id
    reachable by links, class_id the smallest id of the documents with the same set.

    Texts without words (null, empty, blank) have no shingles, link with nothing and are their own
    component of size 1 (class_id and component_id are their id).  Null ids are never the smallest: a
    component of null ids alone has a null id.  Rows that repeat a document have the same result; an
    empty table gives an empty result; other columns are ignored.  row_key is ``row_key`` of id and
    text, component_key tells components apart where ids repeat (null for texts without words).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), row_key(id_col, text_col).alias("row_key"))
    ranks = spark.sparkContext.broadcast(rarity(rows, n))  # fixed size
    sets = stored(document_sets(rows, n, percent, ranks), "shingle-sets")
    classes = stored(sets.filter("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"),
        F.first("histogram", ignorenulls=True).alias("histogram")), "classes")
    # straight from the documents, so prefixes are not shuffled by class first: a class comes once a task at most
    postings = sets.select("c", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("tokens", "positions")).alias("p")).select(
        "c", "n", F.col("p.positions").alias("pos"), F.col("p.tokens").alias("token"))
    # the tokens alone say which have several entries (counted map-side); only entries of these go further
    repeated = postings.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    met = stored(postings.join(repeated, "token"), "met")
    place = F.struct("pos", "c")  # a class has a shingle at one position, so equal ends are copies of one class
    lists = met.groupBy("token").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least != most")
    postings = stored(met.join(lists.select("token", F.col("least.c").alias("leader")), "token").distinct(), "postings")
    discard(met)

    leaders = postings.filter("c != leader").select(
        F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).distinct()
    first = stored(bounded(leaders, classes, percent), "leader-pairs")
    pairs, ids = first, stored(first.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ids")
    first = stored(counted(pairs, sets_of(rows, n, ids), differences=True), "leader-answers")
    discard(pairs, ids)
    linked = lambda df: df.filter(enough(F.col("common"), F.col("na"), F.col("nb"), percent)).select("a", "b")
    groups = stored(components(linked(first)), "groups")

    second = list_pairs(postings.select("token", "c", "n", "pos"), groups, percent)
    second = stored(bounded(second.join(first, ["a", "b"], "left_anti"), classes, percent), "list-pairs")
    discard(postings)
    near = first.filter("only_a is not null")
    # differences of a class from a leader, in both directions
    away = near.select(F.col("a").alias("c"), F.col("b").alias("leader"), F.col("only_a").alias("plus"), F.col("only_b").alias("minus"),
                       F.col("nb").alias("nl")).union(near.select("b", "a", "only_b", "only_a", "na"))
    side = lambda x: away.select(F.col("c").alias(x), "leader", F.col("plus").alias(f"p{x}"),
                                 F.col("minus").alias(f"m{x}"), F.col("nl").alias(f"l{x}"))
    derived = second.join(side("a"), "a").join(side("b"), ["b", "leader"]).select(
        "a", "b", "na", "nb", (F.col("la") - F.size("ma") - F.size("mb") + F.size(F.array_intersect("ma", "mb"))
                               + F.size(F.array_intersect("pa", "pb"))).cast("bigint").alias("common"))
    derived = stored(derived.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"),
                                                   F.first("common").alias("common")), "derived")
    rest = stored(second.join(derived, ["a", "b"], "left_anti"), "rest")
    ids = stored(rest.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "ids")
    more = linked(derived)
    if not ids.isEmpty():
        more = more.union(linked(counted(rest, sets_of(rows, n, ids), differences=False)))
    more = stored(more, "list-links")
    if not more.isEmpty():
        groups = stored(components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "groups")

    placed = classes.join(groups.withColumnRenamed("node", "c"), "c", "left").select(
        "c", "class_id", "copies", F.coalesce("root", "c").alias("root"))
    whole = placed.groupBy("root").agg(F.min("class_id").alias("component_id"), F.sum("copies").alias("component_size"))
    placed = placed.join(whole, "root").select("c", "class_id", "component_id", "component_size", "root")
    out = sets.select("doc_id", "row_key", "n_shingles", "c").join(placed, "c", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "row_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.when(alone, 1).otherwise(F.col("component_size")).cast("bigint").alias("component_size"),
                      F.col("root").alias("component_key"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but one document of each component: the one with the smallest id stays
    (nulls last, ties by row_key), and of rows equal in id and text one.  Texts without words stay."""
    found = stored(near_duplicates(docs, n, percent, id_col, text_col).filter("component_key is not null")
                   .select("doc_id", "row_key", "component_key"), "duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    first = found.groupBy("component_key").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1")
    drop = found.join(first, "component_key").filter("row_key != first.row_key").select("row_key").distinct()
    mark = "__row_key"
    out = docs.withColumn(mark, row_key(id_col, text_col)).join(
        drop.withColumnRenamed("row_key", mark), mark, "left_anti")
    again = stored(found.groupBy("row_key").agg(F.count("*").alias("k")).filter("k > 1")
                   .select(F.col("row_key").alias(mark)), "repeated-rows")
    if not again.isEmpty():
        one = out.join(again, mark, "left_semi").groupBy(mark).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns])
        out = out.join(again, mark, "left_anti").unionByName(one)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
