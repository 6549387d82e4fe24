"""Near duplicates by an exact Jaccard join of 5-word shingle sets, with documents grouped by their prefixes.

Two documents link when 100 * |A & B| >= 80 * |A | B|.  If all sets are ordered by one global order, such a pair
shares a shingle among the first |A| - ceil(0.8 |A|) + 1 of each.  The order here is by document frequency over the
whole corpus, then by hash; a shingle of one document comes first and needs no index entry at all.

1. Each set is reduced to a 64-bit fingerprint; equal sets (copies) are one set from here on.
   Rows and ids stay in a plain table; from here on a set travels alone, however many copies it has.
2. Shingles meet by hash, packed by task; those of two sets or more go back to their sets with their frequency.
   The most frequent ones are counted map-side beforehand and go straight to their sets.
   They travel as tokens of 32 bits besides their part; a token that two shingles share only adds candidates, since
   a prefix of the same length over the (fewer) tokens still holds a common one.
3. A set keeps its shared prefix.  Sets of one size with the same prefix form a group.
4. Star round: within groups, and within index lists, each set is verified against one head only.
5. What is left are pairs of groups of different components.  They are filtered by size and by the overlap that
   the positions still allow, then expanded to members and verified.
6. Components of all links, by rounds of hooking labels to the smallest neighbour.

Components need a star of thousands of near copies and not a square; no pair of different components is left out.
The links inside components are then counted, or listed, by comparing blocks of sets as matrices.  Sets are compared by 64-bit shingle hashes.

Null or empty texts have an empty set and link with nothing.  A text of fewer than five words is one shingle.  A
null id keeps its row; its component is the smallest id that is not null.  Repeated rows keep their rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compovec.llm.common import documents, map_texts, materialise, words
from compovec.llm.doc_stats import mix

SHINGLE = 5
PERCENT = 80
#: Characters of text whose shingles one counting task gets.
CHARS_PER_PART = 8 << 20
#: Ids that may be broadcast to filter the second scan; beyond that the ids are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A token is hot if slices in which at least HOT_LOCAL different sets have it add up to HOT sets or more.
HOT_LOCAL, HOT = 16, 10_000
#: Hot tokens that the driver may hold; the rest, the least frequent of them, meet like other tokens.
MOST_HOT = 100_000
#: Sets and shingles of one block of the comparison inside components.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
#: Columns of the incidence matrix that are in memory at a time.
COLUMNS = 2048
#: Tasks that share the block counts of one component.
SALT = 16


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, ordered by row and hash."""
    rows, flat = words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes = flat.dictionary_encode()
    known = codes.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashed = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    h = hashed[codes.indices.to_numpy()] if len(known) else hashed
    n_words = np.bincount(rows, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    starts, lengths = [], []
    if len(rows) >= SHINGLE:
        at = np.flatnonzero(rows[SHINGLE - 1:] == rows[:len(rows) - SHINGLE + 1])
        starts.append(at)
        lengths.append(np.full(len(at), SHINGLE))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    starts.append(first[short])
    lengths.append(n_words[short])
    start, length = np.concatenate(starts), np.concatenate(lengths)
    key = mix(length.astype(np.uint64))
    for j in range(SHINGLE):
        inside = j < length
        step = mix(key ^ h[np.minimum(start + j, max(len(h) - 1, 0))]) if len(h) else key
        key = np.where(inside, step, key)
    row = rows[start] if len(start) else np.zeros(0, np.int64)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def sizes_and_prints(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and fingerprint of each row."""
    size = np.bincount(row, minlength=n)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        total[some] = np.add.reduceat(mix(key ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(size) - size)[some])
    return size, mix(total ^ size.astype(np.uint64))


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Shingles of the prefix: size - ceil(PERCENT / 100 * size) + 1."""
    return size - (PERCENT * size + 99) // 100 + 1


def tokens_of(row: np.ndarray, key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, part and 32 bits of each distinct token of a row, ordered by part."""
    part = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    row, key, part = row[order], (key[order] >> np.uint64(32)).astype("<u4"), part[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return row[new], part[new], key[new]


def whole(part: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A token is its part and 32 bits."""
    return (part.astype(np.int64) << 32) | key.astype(np.int64)


def one_of_equal(print_: np.ndarray) -> np.ndarray:
    """Marks one of the equal sets of a slice."""
    one = np.zeros(len(print_), bool)
    one[np.unique(print_, return_index=True)[1]] = True
    return one


def home_of(print_: np.ndarray, parts: int) -> np.ndarray:
    """The home of a set, as F.pmod has it."""
    return print_.view(np.int64) % parts


#: Rows of one table: a member (a row of the input), or a token that many different sets of one slice have.
DESCRIBED = "doc_id long, print long, size int, tokens int, token long, sets int"


def describe(parts: int, often: int):
    """Each row's set in numbers, and the tokens that at least ``often`` different sets of the slice have."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        row, key = shingle_sets(b.column("text"))
        size, print_ = sizes_and_prints(row, key, n)
        row, part, key = tokens_of(row, key, parts)
        known, sets = np.unique(whole(part, key)[one_of_equal(print_)[row]], return_counts=True)
        known, sets = known[sets >= often], sets[sets >= often]
        none = lambda k, m: pa.nulls(m, k)
        columns = [(b.column("doc_id").cast(pa.int64()), none(pa.int64(), len(known))), (pa.array(print_.view(np.int64)), none(pa.int64(), len(known))),
                   (pa.array(size, pa.int32()), none(pa.int32(), len(known))), (pa.array(np.bincount(row, minlength=n), pa.int32()), none(pa.int32(), len(known))),
                   (none(pa.int64(), n), pa.array(known, pa.int64())), (none(pa.int32(), n), pa.array(sets, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=[f.split()[0] for f in DESCRIBED.split(", ")])
    return run


def hot_tokens(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of very many sets and their counts, ordered by token.

    Counts add up map-side.  They need not be exact, as any order of the tokens will do that is the same for all
    sets; so a token that is rare in some slices, or a set that several slices have, does no harm.
    """
    found = described.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= HOT)
    rows = sorted((r.token, r.sets) for r in found.orderBy(F.desc("sets"), "token").limit(MOST_HOT).collect())
    return np.array([t for t, _ in rows], np.int64), np.minimum([c for _, c in rows], (1 << 32) - 1).astype("<u4")


def emit(parts: int, hot: np.ndarray):
    """Map side: per slice and part the tokens of the sets.  Hot tokens need not meet; they go to the part of their set's home."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        row, key = shingle_sets(b.column("text"))
        _, print_ = sizes_and_prints(row, key, b.num_rows)
        row, part, key = tokens_of(row, key, parts)
        one = one_of_equal(print_)[row]
        row, part, key = row[one], part[one], key[one]
        out = {k: [] for k in ("part", "prints", "counts", "keys")}

        def put(part, row, key):
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.zeros(0, np.int64)
            for x, y in zip(cut[:-1], cut[1:]):
                own, count = np.unique(row[x:y], return_counts=True)
                for name, v in (("part", int(part[x])), ("prints", print_[own].tobytes()), ("counts", count.astype("<u4").tobytes()), ("keys", key[x:y].astype("<u4").tobytes())):
                    out[name].append(v)

        part = part.astype(np.int64)
        if len(hot):
            token = whole(part, key)
            at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
            is_hot = hot[at] == token
            home = parts + home_of(print_[row[is_hot]], parts)
            order = np.lexsort((row[is_hot], home))
            put(home[order], row[is_hot][order], at[is_hot][order])
            row, part, key = row[~is_hot], part[~is_hot], key[~is_hot]
        put(part, row, key)
        kinds = {"part": pa.int32(), "prints": pa.binary(), "counts": pa.binary(), "keys": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(out[k], kinds[k]) for k in kinds], names=list(kinds))
    return run


BLOCK = "part int, prints binary, counts binary, keys binary"
#: Tokens on the way back to their sets.
MET = "home int, prints binary, keys binary, counts binary"


def u64(chunks) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), np.uint64)


def u32(chunks) -> np.ndarray:
    return np.frombuffer(b"".join(chunks), "<u4").astype(np.int64)


def meet(parts: int, hot: np.ndarray, hot_counts: np.ndarray):
    """Tokens of one part: those of at least two sets are sent home with their frequency."""
    def run(table: pa.Table) -> pa.Table:
        out = {k: [] for k in ("home", "prints", "keys", "counts")}
        part = table.column("part")[0].as_py()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4")
        prints = np.repeat(u64(table.column("prints").to_pylist()), u32(table.column("counts").to_pylist()))
        order = np.lexsort((prints, keys))
        keys, prints = keys[order], prints[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])      # copies from several slices
        keys, prints = keys[new], prints[new]
        if part >= parts:
            keys, count = hot[keys].astype(np.uint64), hot_counts[keys]
        else:
            head = np.ones(len(keys), bool)
            head[1:] = keys[1:] != keys[:-1]
            at = np.flatnonzero(head)
            count = np.repeat(np.diff(np.append(at, len(keys))), np.diff(np.append(at, len(keys))))
            shared = count > 1
            keys, prints, count = np.uint64(part << 32) | keys[shared].astype(np.uint64), prints[shared], count[shared].astype("<u4")
        home = home_of(prints, parts)
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[cut[p]:cut[p + 1]]
            if len(own):
                for name, v in (("home", p), ("prints", prints[own].tobytes()), ("keys", keys[own].tobytes()), ("counts", count[own].tobytes())):
                    out[name].append(v)
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(out[k], t) for k, t in zip(out, kinds)], names=list(out))
    return run


POSTING = "print long, size int, class_id long, prefix_group long, token long, place int, alone int"


def choose_prefix(hits: pa.Table, classes: pa.Table) -> pa.Table:
    """Shared prefix of each set of one home, and the group of its size and prefix.  ``classes`` has one row per set."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [f.split()[0] for f in POSTING.split(", ")]
    keys = u64(hits.column("keys").to_pylist())
    if not len(keys) or not classes.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    prints = classes.column("print").to_numpy().view(np.uint64)
    order = np.argsort(prints)
    prints = prints[order]
    sizes, lengths, ids = (classes.column(c).to_numpy()[order].astype(np.int64) for c in ("size", "tokens", "class_id"))
    own, count = u64(hits.column("prints").to_pylist()), u32(hits.column("counts").to_pylist())
    order = np.lexsort((keys, count, own))
    own, keys = own[order], keys[order]
    at = np.searchsorted(prints, own)
    alone = lengths - np.bincount(at, minlength=len(prints))                # tokens of one set come first
    head = np.ones(len(own), bool)
    head[1:] = own[1:] != own[:-1]
    begin = np.flatnonzero(head)
    rank = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
    place = alone[at] + rank
    keep = place < prefix_length(sizes)[at]
    at, keys, place = at[keep], keys[keep], place[keep]
    if not len(at):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    total = np.zeros(len(prints), np.uint64)
    np.add.at(total, at, mix(keys ^ np.uint64(0x2545F4914F6CDD1D)))
    group = mix(total ^ mix(sizes.astype(np.uint64)))
    signed = lambda x: x.view(np.int64)
    return pa.table([pa.array(v, k) for v, k in zip((signed(prints[at]), sizes[at], ids[at], signed(group[at]), signed(keys), place, alone[at]), kinds)], names=names)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; one row per pair, compared in Arrow batches."""
    left = sets.select(F.col("print").alias("a"), F.col("keys").alias("keys_a"))
    right = sets.select(F.col("print").alias("b"), F.col("keys").alias("keys_b"))

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("keys_a").to_pylist(), b.column("keys_b").to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep[i] = 100 * common >= PERCENT * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links, label being the smallest node it reaches.

    Each round relabels every node to the smallest label next to its own and drops links inside a label, so
    links shrink to none in a number of rounds that grows with the logarithm of a component's size.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).distinct(), "edges")
    label = materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("b")).where(F.col("b") < F.col("a")), "hooks")
        # follow the hooks once more: a label that hooks to one that itself hooks
        onward = hook.select(F.col("a").alias("b"), F.col("b").alias("next"))
        hook = materialise(hook.join(onward, "b", "left").select("a", F.coalesce("next", "b").alias("to")), "hooks")
        label = materialise(label.join(hook, label["label"] == hook["a"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        to_a, to_b = hook.select("a", F.col("to").alias("ta")), hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
        edges = materialise(moved.where(F.col("a") != F.col("b")).distinct(), "edges")
    return label


def compatible(x, y):
    """Sizes that allow the similarity."""
    return (100 * F.least(x, y)) >= (PERCENT * F.greatest(x, y))


def with_part(posts: DataFrame, label: DataFrame | None) -> DataFrame:
    """Postings with the component so far of each set, itself where it has no link yet."""
    if label is None:
        return posts.withColumn("part", F.col("print"))
    label = label.select(F.col("node").alias("print"), "label")
    return posts.join(label, "print", "left").withColumn("part", F.coalesce("label", "print")).drop("label")


def star_pairs(posts: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """At most two pairs per set with sets of other components: the head of its group, and the head it meets most often
    in index lists.  The head is the set with the fewest tokens of its own, the likeliest origin of near copies."""
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    rows = with_part(posts, label).select("print", "part", "prefix_group", "token", band.alias("band"), F.struct("alone", "print", "part").alias("origin"))
    heads = rows.groupBy("token", "band").agg(F.min("origin").alias("head"), F.min("part").alias("low"), F.max("part").alias("high"))
    heads = heads.where(F.col("low") != F.col("high")).drop("low", "high")
    met = rows.join(heads, ["token", "band"]).where(F.col("part") != F.col("head.part")).groupBy("print", "head").count()
    best = met.groupBy("print").agg(F.max_by("head", F.struct("count", "head")).alias("head"))
    members = rows.select("prefix_group", "print", "part", "origin").distinct()
    leaders = members.groupBy("prefix_group").agg(F.min("origin").alias("head"))
    inside = members.join(leaders, "prefix_group").where(F.col("part") != F.col("head.part")).select("print", "head")
    pair = F.array_sort(F.array("print", "head.print"))
    return best.union(inside).select(pair[0].alias("a"), pair[1].alias("b")).distinct()


def remaining_pairs(posts: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of sets of different components that a common prefix shingle, their sizes and its places still allow."""
    rows = with_part(posts, label)
    mixed = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where(F.col("low") != F.col("high")).select("token")
    rows = materialise(rows.join(mixed, "token", "left_semi"), "mixed")
    units = rows.select("token", "prefix_group", "part", "size", "place").distinct()       # members of a group and component are one
    x = units.select("token", *[F.col(c).alias(f"{c}_x") for c in ("prefix_group", "part", "size", "place")])
    y = units.select("token", *[F.col(c).alias(f"{c}_y") for c in ("prefix_group", "part", "size", "place")])
    # at the first common token of a similar pair enough tokens must follow in both; at a later one the test is stricter,
    # so a pair passes somewhere exactly if it passes there
    follow = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y"))
    enough = follow * (100 + PERCENT) >= PERCENT * (F.col("size_x") + F.col("size_y"))
    met = x.join(y, "token").where((F.col("part_x") < F.col("part_y")) & compatible(F.col("size_x"), F.col("size_y")) & enough)
    pairs = met.select("prefix_group_x", "part_x", "prefix_group_y", "part_y").distinct()
    member = rows.select("prefix_group", "part", "print").distinct()
    mx = member.select(F.col("prefix_group").alias("prefix_group_x"), F.col("part").alias("part_x"), F.col("print").alias("a"))
    my = member.select(F.col("prefix_group").alias("prefix_group_y"), F.col("part").alias("part_y"), F.col("print").alias("b"))
    return pairs.join(mx, ["prefix_group_x", "part_x"]).join(my, ["prefix_group_y", "part_y"]).select("a", "b").distinct()


def compare(as_pairs: bool):
    """Blocks of sets, ordered by the pair of blocks: the similar pairs, or per set the rows that all similar sets of the pair stand for."""
    names = ("print", "class_id", "copies", "keys", "second")

    def flush(print_, class_id, copies, keys, second, same):
        second = np.array(second, bool)
        x = np.flatnonzero(~second)
        y = x if same else np.flatnonzero(second)
        if not len(x) or not len(y) or same and len(x) < 2:
            return
        size = np.fromiter(map(len, keys), np.int64, len(keys)) // 8
        row = np.repeat(np.arange(len(keys)), size)
        _, column, often = np.unique(u64(keys), return_inverse=True, return_counts=True)
        shared = often[column] > 1                                          # a shingle of one set is common to no pair
        row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(x), len(y)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            u, v = np.searchsorted(column, [at, at + COLUMNS])
            has = np.zeros((len(keys), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
            has[row[u:v], column[u:v] - at] = 1
            common += has[x] @ has[y].T
        copies = np.array(copies, np.float64)
        links = [np.zeros(len(x)), np.zeros(len(y))]
        for at in range(0, len(x), 256):                                    # some rows at a time: the pairs may be many
            own = common[at:at + 256].astype(np.int64)
            both = size[x[at:at + 256], None] + size[y]
            similar = (100 + PERCENT) * own >= PERCENT * both
            if same:
                similar[np.arange(len(own)), at + np.arange(len(own))] = False
            if not as_pairs:
                links[0][at:at + 256] = similar @ copies[y]
                if not same:
                    links[1] += copies[x[at:at + 256]] @ similar
                continue
            i, j = np.nonzero(np.triu(similar, at + 1) if same else similar)
            a, b = x[at + i], y[j]
            flip = np.array([(class_id[q] is not None, class_id[q] or 0, print_[q]) < (class_id[p] is not None, class_id[p] or 0, print_[p]) for p, q in zip(a, b)], bool)
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            ids = pa.array(class_id, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(own[i, j]), pa.array((both - own)[i, j])], names=["class_a", "class_b", "n_common", "n_union"])
        if not as_pairs:
            for at, n in zip((x, y), links[:1] if same else links):
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(print_, np.int64)[at[some]]), pa.array(n[some].astype(np.int64))], names=["print", "links"])

    def run(batches):
        last, held = None, {}
        for b in batches:
            at = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("label", "band", "across", "i", "j")]) if b.num_rows else np.zeros((5, 0), np.int64)
            cut = np.append(np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(0))) if b.num_rows else [], b.num_rows).astype(int)
            for u, v in zip(cut[:-1], cut[1:]):
                if last != (now := tuple(at[:, u])):
                    if last is not None:
                        yield from flush(**held, same=not last[2] and last[3] == last[4])
                    last, held = now, {c: [] for c in ("print_", "class_id", "copies", "keys", "second")}
                for c, name in zip(held, names):
                    held[c] += b.column(name).slice(u, v - u).to_pylist()
        if last is not None:
            yield from flush(**held, same=not last[2] and last[3] == last[4])
    return run


def inside(label: DataFrame, classes: DataFrame, sets: DataFrame, as_pairs: bool) -> DataFrame:
    """All similar pairs of different sets, which are inside components.

    The sets of a component are cut into blocks of similar size; each pair of blocks whose sizes allow the similarity is
    compared in one matrix product.  A set travels once per block it meets, and not once per pair.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.3))).cast("int")     # above 100 / PERCENT: only neighbours can be similar
    nodes = label.select(F.col("node").alias("print"), "label").join(classes, "print").withColumn("band", band)
    cuts = nodes.groupBy("label", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("cuts"), F.count(F.lit(1)).alias("n"))
    cuts = materialise(cuts, "cuts")
    up = cuts.select("label", (F.col("band") - 1).alias("band"), F.col("cuts").alias("up"))
    down = cuts.select("label", (F.col("band") + 1).alias("band"), F.col("cuts").alias("down"))
    near = cuts.join(up, ["label", "band"], "left").join(down, ["label", "band"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALT)).cast("int")).join(near, ["label", "band", "salt"])
    block = F.pmod(F.xxhash64(F.lit(3), "print"), F.col("cuts")).cast("int")

    def to(n, fn):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), fn)).otherwise(F.array())

    def pair(low, across, i, j, second):
        return F.struct(low.alias("band"), across.alias("across"), i.alias("i"), j.alias("j"), second.alias("second"))

    own, b = F.col("band"), F.col("block")
    targets = F.concat(
        to(F.when(F.col("n") > 1, F.col("cuts")), lambda k: pair(own, F.lit(0), F.least(b, k), F.greatest(b, k), b > k)),
        to(F.col("up"), lambda k: pair(own, F.lit(1), b, k, F.lit(False))),
        to(F.col("down"), lambda k: pair(own - 1, F.lit(1), k, b, F.lit(True))))
    rows = nodes.withColumn("block", block).select("print", "label", "class_id", "copies", targets.alias("targets")).where(F.size("targets") > 0)
    rows = rows.join(sets, "print").select("print", "label", "class_id", "copies", "keys", F.explode("targets").alias("t"))
    rows = rows.select("label", "t.*", "print", "class_id", "copies", "keys")
    key = ["label", "band", "across", "i", "j"]
    out = "class_a long, class_b long, n_common long, n_union long" if as_pairs else "print long, links long"
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare(as_pairs), out)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (a row per row of the input), classes (a row per different set that is not empty), the sets that may link, and components of their prints."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(4, -(-chars // CHARS_PER_PART))
    described = materialise(map_texts(docs, describe(parts, HOT_LOCAL), DESCRIBED), "members")
    hot, hot_counts = hot_tokens(described)
    members = described.where(F.col("token").isNull()).select("doc_id", "print", F.col("size").cast("long").alias("n_shingles"), "tokens")
    classes = members.where(F.col("n_shingles") > 0).groupBy("print").agg(
        F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("size"), F.min("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "classes")
    met = map_texts(docs, emit(parts, hot), BLOCK).groupBy("part").applyInArrow(meet(parts, hot, hot_counts), MET)
    no_id = F.lit(np.iinfo(np.int64).max)
    homes = classes.select(F.pmod("print", F.lit(parts)).cast("int").alias("home"), "print", "size", "tokens", F.coalesce("class_id", no_id).alias("class_id"))
    posts = materialise(met.groupBy("home").cogroup(homes.groupBy("home")).applyInArrow(choose_prefix, POSTING), "postings")
    # one set per class that has a shared prefix, read again from the text of the class's smallest id
    wanted = posts.select(F.nullif("class_id", no_id).alias("doc_id")).distinct().persist(StorageLevel.DISK_ONLY)
    few = wanted.count() <= BROADCAST_IDS
    ids = F.broadcast(wanted) if few else wanted
    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    own = posts.select("print").distinct()
    sets = map_texts(chosen, pack_sets, "print long, keys binary").join(own, "print", "left_semi")
    sets = materialise(sets.dropDuplicates(["print"]), "sets")
    wanted.unpersist()
    links = materialise(verify(star_pairs(posts), sets), "links")
    label = components(links)
    more = materialise(verify(remaining_pairs(posts, label), sets), "links")
    return members, classes, sets, components(links.union(more))


def join(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set) and n_links (other rows that are similar) of every row."""
    members, classes, sets, label = grouped(docs)
    named = classes.join(label.select(F.col("node").alias("print"), "label"), "print", "left").withColumn("component", F.coalesce("label", "print"))
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    found = named.join(lowest, "component").select("print", "class_id", "component_id", "copies")
    columns = ["doc_id", "n_shingles", "component_id", "class_id"]
    if count_links:
        links = inside(label, classes, sets, False).groupBy("print").agg(F.sum("links").alias("links"))
        found = found.join(links, "print", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        columns.append("n_links")
    linked = members.where(F.col("n_shingles") > 0).join(found, "print").select(*columns)
    empty = members.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(empty.select(*columns))


def class_links(docs: DataFrame) -> DataFrame:
    """All similar pairs of classes by their smallest ids; with class_id of ``join``, all links between rows of different sets."""
    _, classes, sets, label = grouped(docs)
    return inside(label, classes, sets, True)


def pack_sets(b: pa.RecordBatch) -> pa.RecordBatch:
    row, key = shingle_sets(b.column("text"))
    size, print_ = sizes_and_prints(row, key, b.num_rows)
    cut = np.append(0, np.cumsum(size))
    data = [key[a:e].tobytes() for a, e in zip(cut[:-1], cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), pa.array(data, pa.binary())], names=["print", "keys"])


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, with the number of links of each."""
    return join(documents(spark, sf_dir))


def jaccard_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between classes of equal documents; as many as the square of a group of near copies."""
    return class_links(documents(spark, sf_dir))


QUERIES = {"op9_jaccard_groups": op9_jaccard_groups, "jaccard_class_links": jaccard_class_links}
