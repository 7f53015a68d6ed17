"""Near-dedup of the pipeline: SimHash links (operator 5) and all pairs of 5-word Jaccard 0.8 or more.

SimHash misses most pairs just over 0.8, so the second kind of link comes from an exact set join:

* Two sets of that similarity share one of the first n - ceil(0.8 n) + 1 shingles of each in any common
  order.  The order puts shingles that a sample of the texts repeats last; which they are matters to the
  cost alone, not to the pairs.
* These prefixes travel packed: each task sorts its keys and sends one row for each range of keys.  Where a
  range finds a key with a few sets, it names the pairs that pass the bounds by size and by place; those of a
  key with more are joined by a spanning forest.  Keys that the sample tells to be common, and any that turn
  out to be, go entry by entry and are split into pairs of blocks.
* Unrelated texts share a shingle now and then, and the more texts there are, the more of them hang together
  that way.  So candidates are first compared by parity bitmaps of about a bit a shingle, which bound what two
  sets share and lose no pair: named pairs one by one, forests by their components.
* What is left is grouped; the texts of a group meet whole, in blocks, and common shingles are counted.

Equal sets are one node, named by a digest.  Only texts that a filter of fixed size lets through travel: to
their candidates, and to the table of those that go.

Cases: a null or blank text has no shingle; its fingerprint links it.  A text of fewer words than a shingle is
one shingle.  Repeated rows are one node, and one row of them stays; on ties of doc_id the first row stays.
Null ids stay only where a group has no other.  Helper columns start with ``_sh_``, which no input column may.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .graph import components, forest, in_blocks
from .tables import flagged, flags, packed, slices, stored, unpacked

SHINGLE = 5
#: Sets link if 9 * common >= 4 * (a + b), which is Jaccard >= 4/5.
IN_BLOCK = 1_024
#: Entries of one range of keys; sets on one key whose pairs are named; sets on one key that a task compares on its own.
RANGE, NAMED, LONG = 250_000, 64, 8_192
#: Bitmaps that meet in one task.
BITS_IN_BLOCK = 4_096
#: Shingles of whole sets, or pairs of candidates, that a task looks at together.
AT_ONCE = 500_000
#: One text of so many tells which shingles are common; so many hits make one; so many at most are told.
SAMPLE, HITS, TOLD = 8, 3, 1_000_000
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the text's shingles, each once."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # as simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.array([known[w] for w in words], np.uint64)
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(32))) * FACTOR + each[k:len(each) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def digest(found: np.ndarray) -> int:
    import xxhash

    return simhash._signed(xxhash.xxh64_intdigest(found.tobytes()))


def parities(found: np.ndarray) -> bytes:
    """A bit for each remainder of the hashes: whether an odd number of shingles has it.  The width is a power of
    two and at least the set's size; a wider bitmap folds onto a narrower one."""
    width = max(64, 1 << (max(len(found), 1) - 1).bit_length())
    bits = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps, one a row, at half their width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ: at most the number of shingles that are in one set alone.
    So two sets with 9 times that above the sum of their sizes are below Jaccard 4/5."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _rows(bits: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), "<u8").reshape(len(bits), -1)  # all of one width


def still_near(b: pd.DataFrame) -> pd.DataFrame:
    """The pairs (u, v) of ``b`` that the bitmaps ``ub`` and ``vb`` of sets of ``un`` and ``vn`` shingles do not rule out."""
    u, v = b["ub"].to_numpy(), b["vb"].to_numpy()
    ul, vl = b["ub"].map(len).to_numpy(), b["vb"].map(len).to_numpy()
    u, v, wide, narrow = np.where(ul < vl, v, u), np.where(ul < vl, u, v), np.maximum(ul, vl), np.minimum(ul, vl)
    total = b["un"].to_numpy() + b["vn"].to_numpy()
    ok = np.zeros(len(b), bool)
    for w, m in set(zip(wide.tolist(), narrow.tolist())):
        at = np.flatnonzero((wide == w) & (narrow == m))
        x, y = _rows(u[at]), _rows(v[at])
        while x.shape[1] > y.shape[1]:
            x = _folded(x)
        ok[at] = 9 * _differ(x, y) <= total[at]
    return b.loc[ok, ["u", "v"]]


def near_bits(n: np.ndarray, bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of n shingles that neither their sizes nor their bitmaps rule out, in parts."""
    order = np.argsort(n, kind="stable")
    sizes, width = n[order], np.array([len(bits[k]) for k in order])  # both ascend together
    for w in np.unique(width):
        low, end = np.searchsorted(width, [w, w + 1])
        rows = _rows([bits[k] for k in order[low:end]])
        # Sets that may link differ by a quarter at most, so their widths by one step.
        top = np.searchsorted(width, 2 * w, "right")
        if top > end:
            rows = np.concatenate([rows, _folded(_rows([bits[k] for k in order[end:top]]))])
        last = np.searchsorted(4 * sizes[low:top], 5 * sizes[low:end], "right")
        for k in range(end - low):
            near = k + 1 + np.flatnonzero(9 * _differ(rows[k], rows[k + 1:last[k]]) <= sizes[low + k] + sizes[low + k + 1:low + last[k]])
            if len(near):
                yield np.full(len(near), order[low + k]), order[low + near]


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample repeats, ascending, and how often."""
    def find(batches):
        seen: set[int] = set()
        for b in (part for whole in batches for part in slices(whole, 1_024)):
            each = []
            for text in b["text"].fillna(""):
                found = shingles(text)
                if (node := digest(found)) not in seen:
                    seen.add(node)
                    each.append(found)
            if each:
                key, n = np.unique(np.concatenate(each), return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": n})
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    rows = stored(some.mapInPandas(find, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HITS))
    # A bounded table: it sets an order and leaves no pair out.  The highest counts are told, and as many keys of the last as fit.
    told, chosen = 0, F.lit(False)
    for r in sorted(rows.groupBy("n").agg(F.count("*").alias("keys")).collect(), reverse=True):
        share = min(1, (TOLD - told) / r["keys"])
        chosen = (F.col("n") > r["n"]) | (F.col("n") == r["n"]) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
        told += r["keys"]
        if share < 1:
            break
    rows = rows.where(chosen).select("key", "n").toArrow()
    keys, n = (rows[c].to_numpy() for c in ("key", "n"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(found: np.ndarray, keys: np.ndarray, hits: np.ndarray) -> np.ndarray:
    n = len(found)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        found = found[np.lexsort((found, np.where(keys[at] == found, hits[at], 0)))]
    return found[:n - (4 * n + 4) // 5 + 1] if n else found


def may_link(n: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of sets with a common shingle at ``place`` that sizes and places do not rule out, in parts."""
    rest = n - place
    step = max(1, AT_ONCE // max(1, len(n)))
    for k in range(0, len(n), step):
        a, b = n[k:k + step, None], n[None, k:]
        ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (9 * np.minimum(rest[k:k + step, None], rest[None, k:]) >= 4 * (a + b))
        i, j = np.nonzero(np.triu(ok, 1))
        yield i + k, j + k


def united(pairs: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The smallest of n nodes that each reaches over ``pairs``.  Some ``AT_ONCE`` pairs are held, then only the
    forest they leave, so memory follows the nodes, however many pairs a range has."""
    label, held, count = np.arange(n), [], 0
    for i, j in pairs:
        held.append((i, j))
        count += len(i)
        if count >= AT_ONCE:
            label, held, count = _reached(label, held), [], 0
    return _reached(label, held)


def _reached(label: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    u, v = (np.concatenate([label[pair[side]] for pair in held] or [np.zeros(0, int)]) for side in (0, 1))
    return forest(u, v, len(label))[label]


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i > j of sorted sets of Jaccard 4/5 or more.

    Common shingles are counted range by range of their values, so that what is built at once is bounded by
    ``AT_ONCE`` entries, whatever the sets hold.
    """
    if len(sets) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    n = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((len(sets), len(sets)), np.int32)
    parts = 1 + int(n.sum()) // AT_ONCE
    borders = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, borders), [len(s)]]) for s in sets]
    for k in range(parts):
        here = [s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)]
        many = np.array([len(h) for h in here])
        code = np.unique(np.concatenate(here), return_inverse=True)[1]
        bounds, sizes = np.append(0, np.cumsum(many)), np.bincount(code)
        owner = np.repeat(np.arange(len(sets)), many)[np.argsort(code, kind="stable")]
        first = np.cumsum(sizes) - sizes
        for i in range(1, len(sets)):
            mine = code[bounds[i]:bounds[i + 1]]
            mine = mine[sizes[mine] > 1]
            if len(mine):
                held = sizes[mine]
                at = np.repeat(first[mine] - (np.cumsum(held) - held), held) + np.arange(held.sum())
                shared[i, :i] += np.bincount(owner[at], minlength=len(sets))[:i].astype(np.int32)
    i, j = np.nonzero(np.tril(9 * shared.astype(np.int64) >= 4 * (n[:, None] + n[None]), -1))
    return i, j


def _edges(nodes: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    root = united(pairs, len(nodes))
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """(key, node, n, place) of packed rows."""
    key, node, n, place = [], [], [], []
    for r in rows.itertuples(index=False):
        at = unpacked(r.at, r.entries).astype(np.int64)
        key.append(unpacked(r.keys, r.entries)), place.append(unpacked(r.places, r.entries).astype(np.int64))
        node.append(np.frombuffer(r.nodes, np.int64)[at]), n.append(np.frombuffer(r.sizes, np.int64)[at])
    return tuple(map(np.concatenate, (key, node, n, place)))


def prefixes(docs: DataFrame, keys: np.ndarray, hits: np.ndarray, ranges: int) -> DataFrame:
    """Prefix entries of all sets, packed by range of keys; those of keys that the sample tells to be common
    are in range -1.  A task sends equal sets once."""
    told = docs.sparkSession.sparkContext.broadcast((keys, hits))
    borders = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    hot = keys[hits * SAMPLE >= IN_BLOCK]

    def cut(batches):
        seen: set[int] = set()
        for b in (part for whole in batches for part in slices(whole, 1_024)):
            chosen, nodes, sizes = [], [], []
            for text in b["text"].fillna(""):
                found = shingles(text)
                node = digest(found)
                if not len(found) or node in seen:
                    continue
                seen.add(node)
                chosen.append(prefix(found, *told.value)), nodes.append(node), sizes.append(len(found))
            if not nodes:
                continue
            many = [len(c) for c in chosen]
            key, owner, place = np.concatenate(chosen), np.repeat(np.arange(len(nodes)), many), np.concatenate([np.arange(m) for m in many])
            of = np.where(np.isin(key, hot), -1, np.searchsorted(borders, key, "right"))
            order = np.lexsort((key, of))
            key, owner, place, of = key[order], owner[order], place[order], of[order]
            nodes, sizes, rows = np.array(nodes, np.int64), np.array(sizes, np.int64), []
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for i, j in zip(cuts, cuts[1:]):
                here, at = np.unique(owner[i:j], return_inverse=True)
                rows.append((int(of[i]), j - i, packed(key[i:j]), nodes[here].tobytes(), sizes[here].tobytes(), packed(at), packed(place[i:j])))
            yield pd.DataFrame(rows, columns=["range", "entries", "keys", "nodes", "sizes", "at", "places"])
    return stored(docs.select("text").mapInPandas(
        cut, "range int, entries int, keys binary, nodes binary, sizes binary, at binary, places binary"))


def meeting(rows: DataFrame) -> DataFrame:
    """(u, v, kind) of the pairs that share a key and may be similar.  Kind 0 are the pairs themselves, on keys of at
    most ``NAMED`` sets, each once in a range; kind 1 a spanning forest, in each range, of those on longer keys.
    Keys that turn out to have more than ``LONG`` sets are passed on entry by entry, as kind 2."""
    def meet(b: pd.DataFrame) -> pd.DataFrame:
        key, node, n, place = _columns(b)
        order = np.lexsort((node, key))
        order = order[np.append(True, (np.diff(key[order]) > 0) | (np.diff(node[order]) != 0))]
        key, node, n, place = key[order], node[order], n[order], place[order]
        starts = np.flatnonzero(np.append(True, np.diff(key) > 0))
        sizes = np.diff(np.append(starts, len(key)))
        first = starts[sizes == 2]
        a, c, rest = n[first], n[first + 1], np.minimum(n[first] - place[first], n[first + 1] - place[first + 1])
        first = first[(5 * np.minimum(a, c) >= 4 * np.maximum(a, c)) & (9 * rest >= 4 * (a + c))]
        names, at = np.unique(node, return_inverse=True)

        def pairs(least: int, most: int):
            chosen = (sizes >= least) & (sizes <= most)
            for start, size in zip(starts[chosen], sizes[chosen]):
                here = at[start:start + size]
                for i, j in may_link(n[start:start + size], place[start:start + size]):
                    yield here[i], here[j]

        # Nodes ascend within a key, so the smaller of a pair comes first.
        held, count = [at[first] * len(names) + at[first + 1]], 0
        for i, j in pairs(3, NAMED):
            held.append(i * len(names) + j)
            count += len(i)
            if count >= AT_ONCE:
                held, count = [np.unique(np.concatenate(held))], 0
        codes = np.unique(np.concatenate(held))
        named = pd.DataFrame({"u": names[codes // len(names)], "v": names[codes % len(names)], "kind": 0})
        out = [named, _edges(names, pairs(NAMED + 1, LONG)).assign(kind=1)]
        long = np.repeat(sizes > LONG, sizes)
        if long.any():
            out.append(pd.DataFrame({"u": node[long], "v": key[long].view(np.int64), "kind": 2, "n": n[long], "place": place[long]}))
        return pd.concat(out).reindex(columns=["u", "v", "kind", "n", "place"]).fillna({"n": 0, "place": 0})
    return stored(rows.groupBy("range").applyInPandas(meet, "u long, v long, kind int, n int, place int"))


def candidates(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(node, component): the groups of nodes whose texts have to meet.  ``docs`` and ``prints`` share ``_sh_row``."""
    total = prints.agg(F.sum(F.ceil(F.col("n") / 5) + 1)).first()[0] or 0
    rows = prefixes(docs, *common(docs), 1 + total // RANGE)

    def entries(batches):
        for b in batches:
            if len(b):
                key, node, n, place = _columns(b)
                yield pd.DataFrame({"key": key.view(np.int64), "node": node, "n": n, "place": place})
    met = meeting(rows.where("range >= 0"))
    hot = (rows.where("range < 0").drop("range").mapInPandas(entries, "key long, node long, n int, place int")
           .unionByName(met.where("kind = 2").select(F.col("v").alias("key"), F.col("u").alias("node"), "n", "place")))
    hot = stored(hot.distinct())

    def on_a_key(batches):
        for b in batches:
            if len(b):
                yield pd.concat([_edges(np.asarray(nodes, np.int64), may_link(np.asarray(n, np.int64), np.asarray(place, np.int64)))
                                 for nodes, n, place in zip(b["node"], b["n"], b["place"])])
    together = (in_blocks(hot, ["key"], "node", IN_BLOCK).groupBy("key", "_i", "_j").agg(F.collect_list(F.struct("node", "n", "place")).alias("r"))
                .where(F.size("r") > 1).select("r.node", "r.n", "r.place"))
    wide = components(together.mapInPandas(on_a_key, "u long, v long").unionByName(met.where("kind = 1").select("u", "v")).distinct())

    bits = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))  # the same on all rows of a node

    def by_bits(b: pd.DataFrame) -> pd.DataFrame:
        return _edges(b["node"].to_numpy(np.int64), near_bits(b["n"].to_numpy(np.int64), b["bits"].to_list()))
    grouped = (in_blocks(wide.join(bits, "node"), ["component"], "node", BITS_IN_BLOCK).select("component", "_i", "_j", "node", "n", "bits")
               .groupBy("component", "_i", "_j").applyInPandas(by_bits, "u long, v long"))

    def one_by_one(batches):
        for b in batches:
            if len(b):
                yield still_near(b)
    named = met.where("kind = 0").select("u", "v").distinct()
    # Neither side is bounded, so both are dealt by node at every size.
    for side in ("u", "v"):
        of = bits.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("bits").alias(f"{side}b"))
        named = named.hint("merge").join(of, side)
    named = named.mapInPandas(one_by_one, "u long, v long")
    return components(grouped.unionByName(named).distinct())


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of all links between nodes; ``docs`` and ``prints`` share ``_sh_row``."""
    one = stored(prints.groupBy("node").agg(F.min("_sh_row").alias("_sh_row")).join(candidates(docs, prints), "node"))
    pairs = in_blocks(one, ["component"], "node", IN_BLOCK).select("_sh_row", "component", "_i", "_j", "node")
    # Neither side is bounded, so both are dealt by row at every size.
    sets = (docs.where(flagged("_sh_row", flags(one, "_sh_row"))).select("_sh_row", "text").hint("merge")
            .join(pairs, "_sh_row").select("component", "_i", "_j", "node", "text"))

    def verify(b: pd.DataFrame) -> pd.DataFrame:
        return _edges(b["node"].to_numpy(np.int64), [similar([shingles(t) for t in b["text"]])])
    return sets.groupBy("component", "_i", "_j").applyInPandas(verify, "u long, v long").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the smallest doc_id (null ids last).
    Rows are told apart by task and place, so ``docs`` is a stored table, which deals them alike each time."""
    numbered = docs.withColumn("_sh_row", F.monotonically_increasing_id())

    @F.pandas_udf("struct<fp:long,node:long,n:long,bits:binary>")
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts.fillna(""):
            found = shingles(t)
            rows.append((simhash._signed(simhash.fingerprint(t)), digest(found), len(found), parities(found)))
        return pd.DataFrame(rows, columns=["fp", "node", "n", "bits"])
    prints = stored(numbered.select("_sh_row", "doc_id", both("text").alias("p")).select("_sh_row", "doc_id", "p.*"))
    near = prints.select("fp", "node").distinct().join(simhash.groups(prints), "fp").select("node", "group")
    least = near.groupBy("group").agg(F.min("node").alias("v"))
    by_print = near.join(least, "group").select(F.col("node").alias("u"), "v")
    united = components(by_print.unionByName(links(numbered, prints)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_sh_row").alias("row")))
    of = prints.join(united, "node", "left").select("doc_id", "_sh_row", F.coalesce("component", "node").alias("group"))
    chosen = of.groupBy("group").agg(first.alias("least")).select(F.col("least.row").alias("_sh_row"))
    gone = stored(prints.select("_sh_row").join(chosen, "_sh_row", "left_anti"))
    # Only texts that may be gone travel to the table of those that are.
    bits = flags(gone, "_sh_row")
    kept = numbered.where(~flagged("_sh_row", bits)).unionByName(
        numbered.where(flagged("_sh_row", bits)).hint("merge").join(gone, "_sh_row", "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
