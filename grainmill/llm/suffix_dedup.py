"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere are removed.

How the work is spread
1. A text is named by two hashes (`did`, `d2`; 96 bits). Texts met more than once are removed whole where they have
   `length` bytes, and count as one text in what follows, since their places have the same names. A text that very many
   rows hold (more than a HEAVY-th) is looked at in one of them only.
2. Every window of `length` bytes has one anchor: the leftmost smallest of the hashes of its GRAM-byte substrings. Equal
   windows have equal anchors at equal offsets. A document has one anchor in about (length - GRAM) / 2 bytes.
3. An anchor whose hash is met once is alone: nothing around it repeats (most anchors; they go no further). An anchor whose whole context (all windows that
   can hang on it) is met twice repeats as a whole. Both are counted by aggregates that combine before the shuffle.
4. Where the contexts of a gram differ, suffix sorting finds what they share: one context of each kind, met once or more
   often, is sorted (grams whose contexts all repeat as a whole are settled by 3). They are sorted by
   the suffix from the anchor on and by the reversed prefix before it, deep-shallow: a multikey quicksort, in numpy, over
   64-bit characters down to a shallow depth, then blind tries for the groups that are still equal. From the two orders
   and their common-prefix lengths follow, for each window offset, the classes of contexts that share the part before
   and the part behind the anchor; a window repeats if another context is in both of its classes.
5. Grams, contexts and texts with very many rows are dealt to several parts in each join (salted_join). Texts are shuffled once,
   by name; contexts are cut from the same shuffle that the marks are joined to.
6. A gram met in more contexts than a task takes is dealt out in chunks. A window that repeats within its chunk is
   settled there; hashes of the others go, packed, to tasks that each take one range of hashes of all chunks, and with
   them one hash of each settled window of a chunk, which confirms those of other chunks.

Contexts are compared by gram and context hash (128 bits), windows of different chunks by 128 bits.

Defined results: a null text is empty. Offsets are bytes of UTF-8. Matches never cross documents. Rows that share a
doc_id are different documents here; the ids of repeated rows, null ones too, stay with their rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import SALTS, U64, cut, hot_keys, mix, salted_join, utf8

GRAM = 200
CHUNK = 50_000
SHALLOW = 4
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_TABLE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PIECE = 1 << 18
#: In place of a window's start: it is known to repeat. Packs of so many windows go on at once.
SETTLED = 2**64 - 1
PACK = 200_000


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of each substring of `gram` bytes, by position; long texts are taken in pieces."""
    n = len(data) - gram + 1
    out = np.empty(max(n, 0), np.uint64)
    size = min(_PIECE, max(n, 1)) + gram
    powers, back = np.full(size, _BASE), np.full(size, _INVERSE)
    powers[0] = back[0] = U64(1)
    powers, back = np.cumprod(powers), np.cumprod(back)
    for at in range(0, n, _PIECE):
        m = min(_PIECE, n - at)
        part = _TABLE[np.frombuffer(data, np.uint8, m + gram - 1, at)] * powers[: m + gram - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        out[at : at + m] = mix((sums[gram : gram + m] - sums[:m]) * back[:m])
    return out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes, the position of its leftmost smallest; the upper 40 bits of a hash count."""
    n = len(hashes) - width + 1
    out, low = np.empty(max(n, 0), np.int64), U64(2**24 - 1)
    for at in range(0, n, 2**22):
        m = min(2**22, n - at)
        size = m + width - 1
        grid = np.full(-(-size // width) * width, 2**64 - 1, np.uint64)
        grid[:size] = (hashes[at : at + size] & ~low) | np.arange(size, dtype=np.uint64)
        grid = grid.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        out[at : at + m] = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64) + at
    return out


def anchor_rows(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, gram hash, context hash) of the distinct anchors."""
    hashes = gram_hashes(data, GRAM)
    at = anchors(hashes, length - GRAM + 1)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    pos = at[np.r_[True, at[1:] != at[:-1]]]
    context = np.empty(len(pos), np.uint64)
    digest = xxhash.xxh3_64_intdigest
    for i, p in enumerate(pos.tolist()):
        lo = max(0, p - (length - GRAM))
        context[i] = digest(data[lo : p + length], p - lo)
    return pos, hashes[pos], context


# --- sorting -----------------------------------------------------------------------------------------------------------


def _words(strings: list[bytes], depth: int) -> np.ndarray:
    """The first 8 * depth bytes as big-endian 64-bit characters; a short string is filled with zeros."""
    size = 8 * depth
    return np.frombuffer(b"".join(s[:size].ljust(size, b"\0") for s in strings), ">u8").reshape(len(strings), depth)


def _common(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, which has `start` bytes at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    step, at = 64, start
    while a[at : at + step] == b[at : at + step]:
        at += step
    while a[at] == b[at]:
        at += 1
    return at


class BlindTrie:
    """A trie that stores of each node only where its strings first differ; a string is placed by one blind descent and one comparison."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None

    def _byte(self, k: int, at: int) -> int:
        s = self.strings[k]
        return s[at] if at < len(s) else -1

    def insert(self, k: int) -> None:
        """A leaf is a list of equal strings' numbers under key None; a node is [depth, {byte: child}]."""
        if self.root is None:
            self.root = [None, [k]]
            return
        node = self.root
        while node[0] is not None:
            child = node[1].get(self._byte(k, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        common = _common(self.strings[k], other)
        if common == len(other) == len(self.strings[k]):
            node[1].append(k)
            return
        parent, way, node = None, None, self.root
        while node[0] is not None and node[0] < common:
            parent, way = node, self._byte(k, node[0])
            node = node[1][way]
        if node[0] == common:
            node[1][self._byte(k, common)] = [None, [k]]
            return
        with_other = other[common] if common < len(other) else -1
        split = [common, {with_other: node, self._byte(k, common): [None, [k]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][way] = split

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node[0] is None:
                out.extend(node[1])
            else:
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings by (group, string), and each one's common prefix with the one before it (-1 where a group begins)."""
    words = _words(strings, SHALLOW)
    order = np.lexsort((*(words[:, d] for d in range(SHALLOW - 1, -1, -1)), groups))
    w, g = words[order], groups[order]
    tied = np.r_[False, (g[1:] == g[:-1]) & (w[1:] == w[:-1]).all(axis=1)]
    ends = np.flatnonzero(np.r_[~tied, True])
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if hi - lo > 1:
            trie = BlindTrie(strings)
            for k in order[lo:hi].tolist():
                trie.insert(k)
            order[lo:hi] = trie.order()
    common = np.full(len(strings), -1, np.int64)
    same = np.r_[False, g[1:] == g[:-1]]
    listed = order.tolist()
    for i in np.flatnonzero(same).tolist():
        common[i] = _common(strings[listed[i - 1]], strings[listed[i]])
    return order, common


def repeated_windows(before: list[bytes], behind: list[bytes], groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context (the bytes before the anchor; those from it on) a row of flags: at offset o before the anchor, the
    window of `length` bytes is there and is also in another context of the group at the same offset. And a row of flags
    for one context of each such window."""
    n, most = len(before), length - GRAM
    left_order, left_common = deep_shallow([s[::-1] for s in before], groups)
    right_order, right_common = deep_shallow(behind, groups)
    room_left, room_right = np.array([len(s) for s in before]), np.array([len(s) for s in behind])
    flags, first = np.zeros((n, most + 1), bool), np.zeros((n, most + 1), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        fits = np.flatnonzero((room_left >= o) & (room_right >= length - o))
        if len(fits) < 2:
            continue
        left[left_order] = np.cumsum(left_common < o)
        right[right_order] = np.cumsum(right_common < length - o)
        both = left[fits] * (n + 1) + right[fits]
        _, at, back, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        flags[fits[count[back] > 1], o] = True
        first[fits[at[count > 1]], o] = True
    return flags, first


# --- stages ------------------------------------------------------------------------------------------------------------


def _anchors(length: int):
    def run(frames):
        for frame in frames:
            for lo in range(0, len(frame), 256):
                part = frame.iloc[lo : lo + 256]
                found = [anchor_rows(utf8(t), length) for t in part["txt"]]
                yield pd.DataFrame(
                    {
                        "did": np.repeat(part["did"].to_numpy(), [len(f[0]) for f in found]),
                        "d2": np.repeat(part["d2"].to_numpy(), [len(f[0]) for f in found]),
                        "pos": np.concatenate([f[0] for f in found]),
                        "gram": np.concatenate([f[1] for f in found]).view(np.int64),
                        "ctx": np.concatenate([f[2] for f in found]).view(np.int64),
                    }
                )

    return run


def _contexts(length: int):
    """(gram, chunks, lone, did, d2, pos, before, behind) of the anchors that a document's row names."""
    columns = ["gram", "chunks", "lone", "did", "d2", "pos", "before", "behind"]

    def run(frames):
        for frame in frames:
            rows = []
            for did, d2, text, at in zip(frame["did"], frame["d2"], frame["txt"], frame["open"]):
                data = utf8(text)
                for a in at:
                    p = a["pos"]
                    rows.append((a["gram"], a["chunks"], a["lone"], did, d2, p, data[max(0, p - (length - GRAM)) : p], data[p : p + length]))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def spans_of(flags: np.ndarray, pos: int, length: int) -> list[tuple[int, int]]:
    """The byte spans that the flagged windows cover: a flag at o is a window that starts o bytes before pos."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    ends = np.flatnonzero(np.diff(at) > 1)
    return [(pos - int(hi), pos - int(lo) + length) for lo, hi in zip(at[np.r_[0, ends + 1]], at[np.r_[ends, len(at) - 1]])]


def _sorted_groups(length: int, pack_ranges: int):
    """Contexts in order of (gram, chunk): found spans, and packed hashes of the windows of grams in several chunks."""

    def settle(f: pd.DataFrame):
        f = f.drop_duplicates(["gram", "did", "d2", "pos"], ignore_index=True)
        before, behind = f["before"].to_list(), f["behind"].to_list()
        key = np.r_[True, (f["gram"].to_numpy()[1:] != f["gram"].to_numpy()[:-1]) | (f["chunk"].to_numpy()[1:] != f["chunk"].to_numpy()[:-1])]
        flags, first = repeated_windows(before, behind, np.cumsum(key), length)
        did, d2, pos, chunks = f["did"].to_numpy(), f["d2"].to_numpy(), f["pos"].to_numpy(), f["chunks"].to_numpy()
        # The places of a context that is met more than once are marked whole already.
        lone = f["lone"].to_numpy(bool)
        out = [(int(did[i]), int(d2[i]), lo, hi) for i in np.flatnonzero(flags.any(axis=1) & lone) for lo, hi in spans_of(flags[i], int(pos[i]), length)]
        yield pd.DataFrame({"did": [o[0] for o in out], "d2": [o[1] for o in out], "lo": [o[2] for o in out], "hi": [o[3] for o in out], "part": pd.array([None] * len(out), "Int32"), "packed": [None] * len(out)})
        packs: dict[int, list] = {}
        size = 0
        for i in np.flatnonzero(chunks > 1):
            data, cut_at = before[i] + behind[i], len(before[i])
            for o in range(min(length - GRAM, cut_at) + 1):
                if (first[i, o] or not flags[i, o]) and len(behind[i]) >= length - o:
                    h = xxhash.xxh3_128_intdigest(data[cut_at - o : cut_at - o + length])
                    place = (0, SETTLED) if flags[i, o] or not lone[i] else (int(did[i]) % 2**64, (int(d2[i]) % 2**32 << 32) + int(pos[i]) - o)
                    packs.setdefault(h % pack_ranges, []).append((h >> 64, h % 2**64, *place))
                    size += 1
            if size > PACK:
                yield packed(packs)
                packs, size = {}, 0
        if packs:
            yield packed(packs)

    def packed(packs: dict[int, list]) -> pd.DataFrame:
        return pd.DataFrame({"did": -1, "d2": -1, "lo": -1, "hi": -1, "part": pd.array(list(packs), "Int32"), "packed": [np.array(v, np.uint64).tobytes() for v in packs.values()]})

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(frame) < 5_000:
                rest = frame
                continue
            last = (frame["gram"] == frame["gram"].iloc[-1]) & (frame["chunk"] == frame["chunk"].iloc[-1])
            rest, whole = frame[last], frame[~last]
            if len(whole):
                yield from settle(whole)
        if rest is not None and len(rest):
            yield from settle(rest)

    return run


def _across_chunks(length: int):
    """Rows of one range of window hashes together: the windows that are in two chunks, or in one where they are settled."""

    def found(packs: list[bytes]):
        # A window can hang on several anchors of its own text; it counts once.
        rows = np.unique(np.frombuffer(b"".join(packs), np.uint64).reshape(-1, 4), axis=0)
        known = rows[:, 3] == U64(SETTLED)
        # Rows are in order, so equal windows stand together.
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        hit = rows[(count > 1) & ~known]
        at = (hit[:, 3] & U64(2**32 - 1)).astype(np.int64)
        return pd.DataFrame({"did": hit[:, 2].astype(np.int64), "d2": (hit[:, 3] >> U64(32)).astype(np.uint32).view(np.int32), "lo": at, "hi": at + length})

    def run(frames):
        part, packs = None, []
        for frame in frames:
            for this, packed in zip(frame["part"], frame["packed"]):
                if this != part and packs:
                    yield found(packs)
                    packs = []
                part = this
                packs.append(packed)
        if packs:
            yield found(packs)

    return run


def _cleaned(length: int):
    def run(frames):
        for frame in frames:
            n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
            for text, marks in zip(frame["txt"], frame["marks"]):
                data = utf8(text)
                found = sorted((m["lo"], min(m["hi"], len(data))) for m in marks) if marks is not None else []
                if found and found[0][0] < 0:
                    found = [(0, len(data))]
                runs: list[list[int]] = []
                for lo, hi in found:
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                stay, at = [], 0
                for lo, hi in runs:
                    stay.append(data[at:lo])
                    at = hi
                stay.append(data[at:])
                n_bytes.append(len(data))
                n_removed.append(sum(hi - lo for lo, hi in runs))
                n_spans.append(len(runs))
                kept.append(b"".join(stay))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"].array, "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans, "spans": spans, "kept": kept, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans (long), spans array<struct<lo,hi>>, kept (binary), kept_sha256."""
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    base = base.withColumn("did", F.xxhash64("txt")).withColumn("d2", F.hash("txt"))
    name = ["did", "d2"]
    copied = cut(base.filter(F.octet_length("txt") >= length).groupBy(*name).agg(F.count("*").alias("n"), F.max("doc_id").alias("one")).filter("n > 1"))
    # Texts with a bounded number of names: what so many rows hold is looked at in one row, and its rows are dealt to several parts.
    hot = F.broadcast(copied.join(F.broadcast(hot_keys(copied, name, copied.agg(F.sum("n")).first()[0] or 0)), name).select(*name, "one"))
    marked = base.join(hot, name, "left")
    part = lambda of, at: F.coalesce(F.when(of.isNotNull(), F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")), F.lit(0))
    by_name = marked.select("doc_id", "txt", *name, part(F.col("one"), "doc_id").alias("salt")).repartition(*name, "salt")
    long_texts = marked.filter((F.octet_length("txt") >= length) & (F.col("one").isNull() | (F.col("one") == F.col("doc_id")))).select(*name, "txt")
    found = long_texts.mapInPandas(_anchors(length), "did long, d2 int, pos long, gram long, ctx long").withColumn("pos", F.col("pos").cast("int"))

    place = F.xxhash64(*name, "pos")
    again = cut(found.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("gram", "n"))
    total = again.agg(F.sum("n")).first()[0] or 0
    rows = cut(salted_join(found, again.select("gram"), ["gram"], hot_keys(again, ["gram"], total), [*name, "pos"], "left_semi"))
    # Of each kind one place is taken; its columns come from the same row.
    kinds = cut(
        rows.groupBy("gram", "ctx")
        .agg(F.max_by(F.struct(*name, "pos"), place).alias("at"), (F.min(place) == F.max(place)).alias("lone"), F.count("*").alias("n"))
        .select("gram", "ctx", "at.did", "at.d2", "at.pos", "lone", "n")
    )
    often = kinds.filter("NOT lone")
    whole = salted_join(rows, often.select("gram", "ctx"), ["gram", "ctx"], hot_keys(often, ["gram", "ctx"], total), [*name, "pos"], "left_semi")
    whole = whole.select(*name, F.greatest(F.col("pos").cast("long") - (length - GRAM), F.lit(0).cast("long")).alias("lo"), (F.col("pos").cast("long") + length).alias("hi")).distinct()
    mixed = cut(kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.bool_or("lone").alias("open")).filter("kinds > 1 AND open").drop("open"))
    largest, to_pack, all_kinds = mixed.agg(F.max("kinds"), F.sum(F.when(F.col("kinds") > chunk, F.col("kinds"))), F.sum("kinds")).first()
    ranges = 1 + (to_pack or 0) * (length - GRAM + 1) // 1_000_000

    chunks = F.ceil(F.col("kinds") / chunk).cast("int")
    sorted_kinds = salted_join(kinds, mixed, ["gram"], hot_keys(mixed, ["gram"], all_kinds or 0, "kinds"), ["ctx"])
    open_at = sorted_kinds.groupBy(*name).agg(F.collect_list(F.struct("gram", "pos", chunks.alias("chunks"), "lone")).alias("open"))
    # A text of several rows is taken from one of them; where it has parts, from the part that holds this row.
    one = open_at.join(copied.select(*name, "one"), name, "left").join(hot.withColumnRenamed("one", "hot"), name, "left")
    named = one.select(*name, part(F.col("hot"), "one").alias("salt"), "one", "open")
    contexts = (
        by_name.join(named, [*name, "salt"])
        .filter(F.col("one").isNull() | (F.col("doc_id") == F.col("one")))
        .select(*name, "txt", "open")
        .mapInPandas(_contexts(length), "gram long, chunks int, lone boolean, did long, d2 int, pos long, before binary, behind binary")
        .withColumn("chunk", F.pmod(F.xxhash64(*name, "pos"), F.col("chunks")).cast("int"))
        .repartition("gram", "chunk")
        .sortWithinPartitions("gram", "chunk")
        .mapInPandas(_sorted_groups(length, ranges), "did long, d2 int, lo long, hi long, part int, packed binary")
    )
    marks = whole.union(contexts.filter("part IS NULL").select(*name, "lo", "hi"))
    if (largest or 0) > chunk:
        packed = contexts.filter("part IS NOT NULL").select("part", "packed").repartition("part").sortWithinPartitions("part")
        marks = marks.union(packed.mapInPandas(_across_chunks(length), "did long, d2 int, lo long, hi long"))
    # A text of several rows is removed whole: a mark that begins before the text says so.
    marks = marks.union(copied.select(*name, F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")))
    marks = marks.groupBy(*name).agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).join(hot, name, "left")
    parts = F.when(F.col("one").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    marks = marks.select(*name, F.explode(parts).alias("salt"), F.when(F.col("one").isNull(), F.col("marks")).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")))).alias("marks"))
    joined = by_name.join(marks, [*name, "salt"], "left").select("doc_id", "txt", "marks")
    done = joined.mapInPandas(
        _cleaned(length), "doc_id string, n_bytes long, n_removed long, n_spans long, spans array<struct<lo: long, hi: long>>, kept binary, kept_sha256 string"
    )
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_deep_shallow_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """kept_text is what stays as text; a character cut in two is U+FFFD there (the digest is of the bytes)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))
