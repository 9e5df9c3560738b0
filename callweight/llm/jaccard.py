"""Exact n-gram Jaccard join by prefix filters under several global token orders.

1. Every text becomes its set of k-word shingles (48-bit tokens); texts with equal sets share one
   set id and are one node from then on.
2. Tokens are exchanged by hash range, packed, with their set ids. Each range finds the tokens that
   at least two sets hold; only those travel back. A token of one set can neither join nor count
   in an intersection, and every order puts it in front of all others.
3. Let o be the least intersection of two sets of these sizes that reaches the similarity. Under any
   total order the first token they share has a rank of at most n - o in each set. The first order is
   (frequency, h1): a token of rank r in a set of n can serve only partners of up to `top` tokens,
   o(n, top) <= n - r, so a posting lives only while its token is held, in another component, by a
   set whose size lies between n * similarity and top. Sets full of rare tokens, the outliers of a
   group of copies, thus leave the group's common tokens before any pair is made.
4. Pairs of the first order are intersected with the filters of the orders (unique first, h2) and
   (unique first, h3) and with a parity bound, on 16-bit marks of the prefixes; whole token sets
   travel only for pairs that pass all of them, and are compared exactly.
5. Components need no full pair list: rounds of stars, one centre a token, verify links between
   components as long as that makes postings die; then all pairs of different components that share
   a living posting are verified, so no link between components is missed. Pairs inside a component
   are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import compose, connected_components, relabel
from .scale import Scratch, parts_for, small_batches, text_volume
from .text import TOKEN_BITS, chunks, column_bytes, mix, pack48, release, runs, text_sets, unpack48, words

BUCKET_BYTES = 20 << 20  # text behind one token range
EACH = 4  # rounds of stars go on while there are more pairs than this for each living posting
FALL = 0.9  # and while they leave less than this share of the postings
MAPS = 24  # 64-bit words of a set's parity map
STEP = 1.1  # ratio of neighbouring size classes
_U = np.uint64
SLICES = 8
SALTS = (np.uint64(0x51ED270B), np.uint64(0xB492B66F))  # of the second and third order


def need(n: np.ndarray | int, pct: int):
    """Prefix length n - ceil(pct n / 100) + 1: of what a set shares with any partner."""
    return n - (n * pct + 99) // 100 + 1


def overlap(n: np.ndarray | int, m: np.ndarray | int, pct: int):
    """Least intersection of sets of n and m tokens that reaches the similarity."""
    return -(-pct * (n + m) // (100 + pct))


def set_ids(row: np.ndarray, tok: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set id, size) of each row: a 64-bit sum of mixed tokens, mixed again."""
    n = np.bincount(row, minlength=n_rows)
    at, _ = runs(row)
    s = np.zeros(n_rows, np.uint64)
    if len(tok):
        s[row[at]] = np.add.reduceat(mix(tok + _U(0x632BE59BD9B4E019)), at)
    return mix(s + n.astype(np.uint64)).view(np.int64), n


def ids_of(docs: DataFrame, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sid, n) of every document; n is the size of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(1))
            for lo, hi in chunks(off):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                sid, n = set_ids(*text_sets(w, k), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sid), pa.array(n.astype(np.int64))], ["doc_id", "sid", "n"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, sid long, n long")


def _ranges(docs: DataFrame, k: int, buckets: int, text: str) -> DataFrame:
    """(b, n_sets, sids, sizes, counts, tokens): token ranges of a run of documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(0))
            for lo, hi in chunks(off):
                w = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row, tok = text_sets(w, k)
                sid, n = set_ids(row, tok, hi - lo)
                first = np.zeros(hi - lo, bool)
                first[np.unique(sid, return_index=True)[1]] = True  # one copy of each set
                keep = first[row]
                row, tok = row[keep], tok[keep]
                b = ((tok >> _U(TOKEN_BITS - 32)) * _U(buckets)) >> _U(32)
                o = np.argsort(b.astype(np.uint32), kind="stable")
                row, tok, b = row[o], tok[o], b[o]
                cols: list[list] = [[], [], [], [], []]
                for s, ln in zip(*runs(b), strict=True):
                    r, c = runs(row[s : s + ln])
                    at = row[s + r]
                    for to, x in zip(cols, (int(b[s]), sid[at].tobytes(), n[at].astype(np.int32).tobytes(), c.astype(np.int32).tobytes(), pack48(tok[s : s + ln])), strict=True):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["b", "sids", "sizes", "counts", "tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "b int, sids binary, sizes binary, counts binary, tokens binary")


def _column(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def _shared(parts: int):
    """Tokens of one range that two sets or more hold, with their frequency, dealt by set."""

    def run(t: pa.Table) -> pa.Table:
        release()
        sid, size, cnt = _column(t, "sids", np.int64), _column(t, "sizes", np.int32), _column(t, "counts", np.int32)
        tok = unpack48(b"".join(t.column("tokens").to_pylist()))
        first = np.zeros(len(sid), bool)
        first[np.unique(sid, return_index=True)[1]] = True
        owner = np.repeat(np.arange(len(sid), dtype=np.int32), cnt)
        keep = first[owner]
        owner, tok = owner[keep], tok[keep]
        got = []
        low, high = (int(tok.min()), int(tok.max())) if len(tok) else (0, 0)
        for i in range(SLICES):  # a slice of the range at a time bounds the sort's memory
            a, b = low + (high - low + 1) * i // SLICES, low + (high - low + 1) * (i + 1) // SLICES
            at = np.flatnonzero((tok >= _U(a)) & (tok < _U(b)))
            o = np.argsort(tok[at])
            at = at[o]
            s, c = runs(tok[at])
            df = np.repeat(c, c)
            got.append((at[df > 1], df[df > 1]))
        at, df = (np.concatenate(x) for x in zip(*got, strict=True))
        o = np.argsort(at)  # back to the order of owners
        at, df = at[o], df[o]
        owner, tok = owner[at].astype(np.int64), tok[at]
        p = (mix(sid.view(np.uint64)) % _U(parts)).astype(np.int32)[owner]
        o = np.argsort(p, kind="stable")
        owner, tok, df, p = owner[o], tok[o], df[o], p[o]
        cols: list[list] = [[] for _ in range(6)]
        for s, ln in zip(*runs(p), strict=True):
            r, c = runs(owner[s : s + ln])
            at = owner[s + r]
            for to, x in zip(cols, (int(p[s]), sid[at].tobytes(), size[at].tobytes(), c.astype(np.int32).tobytes(), pack48(tok[s : s + ln]), np.minimum(df[s : s + ln], 2**32 - 1).astype(np.uint32).tobytes()), strict=True):
                to.append(x)
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["p", "sids", "sizes", "counts", "tokens", "df"])

    return run


def _sets(pct: int):
    """Per set whose prefixes reach its shared tokens: size, number of unique tokens, shared tokens
    sorted, parity map, marks of its prefixes under the second and third order, in their order,
    and its first prefix."""
    names = ["sid", "n", "alone", "toks", "bits", "two", "three", "pre"]

    def run(t: pa.Table) -> pa.Table:
        release()
        sid, size, cnt = _column(t, "sids", np.int64), _column(t, "sizes", np.int32), _column(t, "counts", np.int32)
        tok = unpack48(b"".join(t.column("tokens").to_pylist()))
        df = _column(t, "df", np.uint32)
        owner = np.repeat(np.arange(len(sid)), cnt)
        o = np.lexsort((tok, sid[owner]))
        owner, tok, df = owner[o], tok[o], df[o]
        h2 = mix(tok ^ SALTS[0])
        pos = ((h2 >> _U(32)) * _U(64 * MAPS)) >> _U(32)  # bit among 64 * MAPS
        cols: list[list] = [[] for _ in names]
        for s, ln in zip(*runs(sid[owner]), strict=True):
            n = int(size[owner[s]])
            room = need(n, pct) - (n - ln)  # what of the prefix its unique tokens leave
            if room <= 0:
                continue
            x = slice(s, s + ln)
            bits = np.bincount(pos[x].astype(np.int64), minlength=64 * MAPS).astype(np.uint8) & 1
            two, three = (tok[x][np.argsort(mix(tok[x] ^ salt), kind="stable")[:room]] for salt in SALTS)
            for to, v in zip(
                cols,
                (
                    int(sid[owner[s]]), n, int(n - ln), pack48(tok[x]), np.packbits(bits).view(np.int64).tolist(), _marks(two), _marks(three),
                    tok[x][np.lexsort((tok[x], df[x]))[:room]].view(np.int64).tolist(),
                ),
                strict=True,
            ):
                to.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _marks(tok: np.ndarray) -> bytes:
    """Two bytes a token: equal tokens have equal marks."""
    return (tok & _U(0xFFFF)).astype(np.uint16).tobytes()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _filters(pct: int):
    """Pairs that pass the parity bound and share a mark in both prefixes of either further order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)
        for t in batches:
            c = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            n, m = c["an"].to_numpy().astype(np.int64), c["bn"].to_numpy().astype(np.int64)
            least = overlap(n, m, pct)
            maps = [c[x].flatten().to_numpy().view(np.uint64).reshape(-1, MAPS) for x in ("abits", "bbits")]
            apart = np.bitwise_count(maps[0] ^ maps[1]).sum(axis=1).astype(np.int64)
            ok = (n + m - apart) // 2 >= least  # |A xor B| is the parity distance at least
            for order in ("two", "three"):
                data, at = zip(*(column_bytes(c[x + order]) for x in "ab"), strict=True)
                for i in np.flatnonzero(ok).tolist():
                    a = np.frombuffer(data[0][at[0][i] : at[0][i + 1]], np.uint16)[: max(0, n[i] - least[i] + 1 - c["aalone"][i].as_py())]
                    b = np.frombuffer(data[1][at[1][i] : at[1][i + 1]], np.uint16)[: max(0, m[i] - least[i] + 1 - c["balone"][i].as_py())]
                    seen[a] = True
                    ok[i] = seen[b].any()
                    seen[a] = False
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([c[x].filter(keep) for x in ("a", "b", "ca", "cb")], ["a", "b", "ca", "cb"])

    return run


def _verify(pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = np.zeros(t.num_rows, bool)
            c = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            na, nb = c["an"].to_numpy(), c["bn"].to_numpy()
            for i in range(t.num_rows):
                k = _common(unpack48(c["atoks"][i].as_buffer()), unpack48(c["btoks"][i].as_buffer()))
                ok[i] = 100 * k >= pct * (int(na[i]) + int(nb[i]) - k)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([c[x].filter(keep) for x in ("ca", "cb")], ["a", "b"])

    return run


PAIR = "a long, b long, ca long, cb long"


def _links(pairs: DataFrame, sets: DataFrame, pct: int, scratch: Scratch) -> DataFrame:
    """(a, b): components (ca, cb) of the pairs (a, b) of sets that have the similarity."""

    def with_sets(p: DataFrame, *columns: str) -> DataFrame:
        for x in "ab":
            p = p.join(sets.select(F.col("sid").alias(x), *(F.col(c).alias(x + c) for c in columns)).hint("merge"), x)
        return p

    few = scratch.keep(with_sets(pairs, "n", "alone", "bits", "two", "three").mapInArrow(_filters(pct), PAIR))
    out = scratch.keep(with_sets(few, "n", "toks").mapInArrow(_verify(pct), "a long, b long").distinct())
    scratch.drop(few)
    return out


def _class(n):
    """Size class of a set; it never falls as n grows, so classes of an interval's ends hold it."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / float(np.log(STEP))).cast("int")


def _living(posts: DataFrame, pct: int) -> DataFrame:
    """Postings whose token is held in another component by a set of a size they can serve."""
    here = posts.groupBy("t", _class(F.col("n")).alias("cls")).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    here = here.groupBy("t").agg(F.collect_list(F.struct("cls", "low", "high")).alias("here"))
    least = F.floor((F.col("n") * pct + 99) / 100)
    served = F.exists("here", lambda x: (x.cls >= _class(least)) & (x.cls <= _class(F.col("top"))) & ((x.low != F.col("comp")) | (x.high != F.col("comp"))))
    return posts.join(here, "t").filter(served).drop("here")


def _meet(x: str, y: str, pct: int):
    """Whether the token both sides hold can be the first that two sets of the similarity share."""
    a, b = (lambda c, s=s: F.col(s + c) for s in (x, y))
    low, high = (lambda p, q: p("n") * pct <= q("n") * 100), (lambda p, q: q("n") <= p("top"))
    return low(a, b) & low(b, a) & high(a, b) & high(b, a) & (a("comp") != b("comp"))


def _apart(x: str, y: str):
    """Parity distance of two sets: |A xor B| at least."""
    return sum((F.bit_count(F.col(x + "bits")[i].bitwiseXOR(F.col(y + "bits")[i])) for i in range(MAPS)), F.lit(0))


def _close(x: str, y: str, pct: int):
    """Whether the parity distance lets two sets reach the similarity."""
    most = (F.col(x + "n") + F.col(y + "n") - _apart(x, y)) / 2
    return most * 100 >= (F.col(x + "n") + F.col(y + "n") - most) * pct


def _pairs(posts: DataFrame) -> int:
    """Pairs of postings of one token in different components."""
    per = posts.groupBy("t", "comp").agg(F.count("*").alias("c")).groupBy("t").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
    return per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0))).first()[0]


def _side(posts: DataFrame, x: str, columns=("sid", "n", "top", "comp")) -> DataFrame:
    return posts.select("t", *(F.col(c).alias(x + c) for c in columns))


PAIRED = ["asid AS a", "bsid AS b", "acomp AS ca", "bcomp AS cb"]


def near_duplicates(docs: DataFrame, k: int = 5, pct: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents grouped by shingle similarity.

    Two documents link when 100 * intersection >= pct * union of their sets of k-word shingles;
    component_id is the smallest doc_id reachable by links. Null, empty and wordless texts have an
    empty set, size 0, and link with nothing; texts of fewer than k words have their whole
    sequence as one shingle; repeated rows link like any equal texts. Rows with a null id link
    too but never name a component unless all its rows are null. An empty table gives no rows;
    extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    volume = text_volume(small_batches(docs), text)
    buckets = parts_for(volume, BUCKET_BYTES, 12)
    members = scratch.keep(ids_of(docs, k, id_col, text))
    packed = _ranges(docs, k, buckets, text).groupBy("b").applyInArrow(_shared(buckets), "p int, sids binary, sizes binary, counts binary, tokens binary, df binary")
    sets = scratch.keep(packed.groupBy("p").applyInArrow(_sets(pct), "sid long, n long, alone long, toks binary, bits array<long>, two binary, three binary, pre array<long>"))
    posts = sets.select("sid", "n", "alone", F.posexplode("pre").alias("rank", "t"), F.col("sid").alias("comp"))
    # A token of this rank serves partners of up to `top` tokens: overlap(n, top) <= n - rank.
    top = F.floor((F.col("n") - F.col("rank") - F.col("alone")) * (100 + pct) / pct) - F.col("n")
    posts = scratch.keep(_living(posts.select("sid", "n", "t", "comp", top.alias("top")), pct))
    # One star a token, around the set in which it ranks lowest for the set's size: the one with the
    # fewest rare tokens, so the middle of a group of copies.
    centre = _side(posts.groupBy("t").agg(F.min_by(F.struct("sid", "n", "top", "comp"), F.struct(-F.col("top") / F.col("n"), F.xxhash64("sid"), "sid")).alias("c")).select("t", "c.*"), "b")
    pairs = _side(posts, "a").join(centre, "t").filter(_meet("a", "b", pct)).selectExpr(*PAIRED).distinct()
    posts, names = _joined(pairs, posts, None, sets, pct, scratch)
    posts, before = scratch.keep(posts.join(sets.select("sid", "bits").hint("merge"), "sid")), posts
    scratch.drop(before)
    left, turn = posts.count(), 0
    while left and _pairs(posts) > EACH * left:
        # A star a token around another set near the middle: each set meets as many members of other
        # components as it has tokens, and the closest of each component is compared.
        turn += 1
        own = ("sid", "n", "top", "comp", "bits")
        centre = _side(posts.groupBy("t").agg(F.min_by(F.struct(*own), F.struct(-F.col("top") / F.col("n") * (F.pmod(F.xxhash64("sid", "t", F.lit(turn)), F.lit(1024)) / 1024), "sid")).alias("c")).select("t", "c.*"), "b", own)
        met = _side(posts, "a", own).join(centre, "t").filter(_meet("a", "b", pct) & _close("a", "b", pct))
        pairs = met.groupBy("asid", "acomp", "bcomp").agg(F.min_by("bsid", F.struct(_apart("a", "b"), "bsid")).alias("bsid")).selectExpr(*PAIRED)
        posts, names = _joined(pairs, posts, names, sets, pct, scratch)
        before, left = left, posts.count()
        if left > FALL * before:
            break
    if left:
        # All pairs that share a living posting. One side of a pair lies outside the token's largest
        # component, so that one is never joined with itself.
        main = posts.groupBy("t", "comp").agg(F.count("*").alias("c")).groupBy("t").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
        sides = posts.join(main, "t")
        own = ("sid", "n", "top", "comp", "bits", "main")
        pairs = _side(sides.filter("comp <> main"), "a", own).join(_side(sides, "b", own), "t")
        pairs = pairs.filter("bcomp = bmain or asid < bsid").filter(_meet("a", "b", pct) & _close("a", "b", pct)).selectExpr(*PAIRED).distinct()
        posts, names = _joined(pairs, posts, names, sets, pct, scratch)
    scratch.drop(sets, posts)
    named = members.withColumn("root", F.col("sid"))
    if names is not None:
        named = relabel(named, "root", names)
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _joined(pairs: DataFrame, posts: DataFrame, names: DataFrame | None, sets: DataFrame, pct: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Living postings and component names after the links among these pairs."""
    links = _links(pairs, sets, pct, scratch)
    if links.isEmpty():
        scratch.drop(links)
        return posts, names
    new = connected_components(links, scratch)
    all_names = scratch.keep(compose(names, new))
    living = scratch.keep(_living(relabel(posts, "comp", new), pct))
    scratch.drop(links, new, posts, *([] if names is None else [names]))
    return living, all_names


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each component the row with the smallest id, with
    all its columns. Texts without words all stay; of rows that share the kept id one stays."""
    near = near_duplicates(docs, k, pct, id_col, text).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    scratch = Scratch(docs.sparkSession, "kept")
    keep = scratch.keep(near.groupBy("doc_id").agg(F.count("*").alias("times"), F.max("n_shingles").alias("n")))
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))  # no column of docs can clash
    out = d.join(keep.hint("merge"), F.col("doc")[id_col].cast("long").eqNullSafe(keep["doc_id"]), "inner")  # what stays grows with the table
    if not keep.filter("times > 1 and n > 0").isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64(F.col("doc")[text]))
        out = out.withColumn("row", F.row_number().over(first)).filter("row = 1 or n = 0")
    return out.select("doc.*")
