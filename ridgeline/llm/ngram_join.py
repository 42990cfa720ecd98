"""N-gram Jaccard join through a token-group matrix, exact for any threshold.

1. Every text becomes its set of shingle hashes. A set is cut by hash into so many parts that two sets over the threshold
   must agree in some of them; each part's hash is a token. A set knows how many tokens it must have in common with any set
   that it links with, so it may leave out its most frequent ones, one fewer than that. Sets that still share a token form groups.
2. In each group every set is compared with the one set that it shares most tokens with. Groups that this connects are done.
3. What is left of a group is cut into blocks. A block's tokens are stored as one union; a set from outside is sent to a block only if
   its tokens in the block's union are as many as a link needs.
4. Where a block is opened, similar sets stand in rows whose shingle unions make a matrix. A set's overlap with a row's union
   bounds that with each member; only rows that reach the bound are opened, and only for sets not yet connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.shared import BLOOM, SMALL_BATCHES, components, map_runs, materialize, table
from ridgeline.llm.words import mixed, pieces, shingles_of, words_of

#: Tokens that a task gathers before it sends them on.
GATHER = 1 << 20
#: Tokens in a bucket, about; a bucket is sorted in memory.
BUCKET_TOKENS = 1 << 17
#: Shingles that a block may hold, and the sets sent to it at a time.
BLOCK_SHINGLES = 1 << 19
#: Sets that are held against one copy of the set that they share most tokens with.
FOLLOWERS = 64
#: Sets whose union makes a row of the matrix.
ROW = 24
#: A shingle is common if a task finds it in this share of its texts; at most HOT_MOST of the most frequent are set aside.
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.001, 4, 1 << 16
U = np.uint64
#: Bits of a token that travel besides its bucket, and the last of them, which tells neighbouring size classes apart.
TOKEN_BYTES = 6


def size_class(n: np.ndarray) -> np.ndarray:
    """Classes of set sizes, each half as large again as the one before."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1.5) + 1e-9).astype(np.int64)


def parts_of_class(c: int, percent: int) -> tuple[int, int]:
    """(parts, spare): the parts of sets whose larger is of class c, and how many parts two linked sets agree in beyond one.

    intersection >= t * union and union + intersection = a + b give union - intersection <= (1 - t) / (1 + t) * (a + b); each
    element in which two sets differ spoils one part at most.
    """
    largest = math.ceil(1.5 ** (c + 1))
    differ = (100 - percent) * 2 * largest // (100 + percent)
    spare = -(-differ // 6)
    return differ + 1 + spare, spare


def tokens_of_set(s: np.ndarray, percent: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, need) for the sorted set s, for its own size class and the next if a linked set may be in that.

    Linked sets agree in more than `spare` parts, with or without the common shingles. A set with e <= spare empty parts so has at least
    need = spare + 1 - e tokens in common with each linked set. Only sets with more empty parts once the common shingles are set aside
    also give the parts of the whole set, and only those with more empty parts even then give the empty parts too; they need one.
    A token's last bit is that of its class, so that the tokens of a set's two classes are told apart.
    """
    n = len(s)
    c = int(size_class(np.array([n]))[0])
    classes = [c]
    if int(size_class(np.array([n * 100 // percent]))[0]) > c:
        classes.append(c + 1)
    rare = s
    if len(hot):
        k = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rare = s[hot[k] != s]
    tokens, needs = [], []
    for k in classes:
        m, spare = parts_of_class(k, percent)
        cuts = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U)
        names = mixed(np.arange(m, dtype=U) + (U(k) << U(32)))
        need, found = 1, []
        for kind, x in ((0, rare), (1, s)):
            begin = np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]])
            full = begin[1:] > begin[:-1]
            empty = m - int(full.sum())
            total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(x))])
            token = mixed(total[begin[1:]] - total[begin[:-1]] + names + U(kind)) & ~U(1) | U(k & 1)
            found.append(token if kind and empty > spare else token[full])
            if empty <= spare:
                need = spare + 1 - empty if not kind else 1
                break
        found = np.unique(np.concatenate(found))
        tokens.append(found)
        needs.append(np.full(len(found), min(need, 255), np.uint8))
    return np.concatenate(tokens), np.concatenate(needs)


def sets_of(piece, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, of = shingles_of(words_of(piece), size)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    begins = np.searchsorted(of, np.arange(len(piece.begins)))
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        yield hashes[a:b]


def set_hash(s: np.ndarray) -> int:
    return int(mixed(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype(np.int64))


def describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(hash, n, count) of the shingles that many of a task's texts hold, with hash null (id, n, set hash) of each text."""
    held, texts = [], 0

    def frequent() -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
        many = counts >= max(HOT_LEAST, HOT_SHARE * texts)
        return hashes[many], counts[many]

    waiting = 0
    for batch in batches:
        ns, fps = [], []
        for piece in pieces(batch.column(1)):
            for s in sets_of(piece, size):
                ns.append(len(s))
                fps.append(set_hash(s))
                held.append(s)
                waiting += len(s)
                texts += 1
            if waiting > 4 * GATHER:
                yield hot_rows(*frequent())
                held, waiting, texts = [], 0, 0
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=["id", "n", "fp", "hot", "texts"],
        )
    yield hot_rows(*frequent())


def hot_rows(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    n = pa.nulls(len(hashes), pa.int64())
    hot, texts = pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))
    return pa.RecordBatch.from_arrays([n, n, n, hot, texts], names=["id", "n", "fp", "hot", "texts"])


def emit_tokens(batches: Iterator[pa.RecordBatch], size: int, percent: int, hot: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(bucket, tokens, ids, needs): the tokens of a task's sets in buckets by their first bits; equal sets that a task has gathered come once."""

    def flush() -> pa.RecordBatch:
        token = np.concatenate(tokens)
        need, of = np.concatenate(needs), np.repeat(np.array(ids, np.int64), list(map(len, tokens)))
        order = np.argsort(token)
        token, need, of = token[order], need[order], of[order]
        bucket = (token >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        end = np.append(begin[1:], len(bucket))
        short = np.ascontiguousarray(token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])
        wide = of.astype("<i8").view(np.uint8).reshape(-1, 8)
        spans = list(zip(begin.tolist(), end.tolist(), strict=True))
        columns = [
            [short[a:b].tobytes() for a, b in spans],
            [wide[a:b].T.tobytes() for a, b in spans],  # like bytes side by side, for compression
            [need[a:b].tobytes() for a, b in spans],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[begin]), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "tokens", "ids", "needs"]
        )

    tokens, needs, ids, seen, waiting = [], [], [], {}, 0
    for batch in batches:
        given = batch.column(0).to_pylist()
        for piece in pieces(batch.column(1)):
            for i, s in enumerate(sets_of(piece, size)):
                own = given[piece.first + i]
                if not len(s) or own is None:
                    continue
                at = seen.setdefault((len(s), set_hash(s)), len(ids))
                if at < len(ids):
                    ids[at] = min(ids[at], own)
                    continue
                token, need = tokens_of_set(s, percent, hot)
                tokens.append(token)
                needs.append(need)
                ids.append(own)
                waiting += len(token)
            if waiting > GATHER:
                yield flush()
                tokens, needs, ids, seen, waiting = [], [], [], {}, 0
    if ids:
        yield flush()


def shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, id, need) of the tokens that several ids have; equal buckets stand together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = None

    def close() -> pa.RecordBatch:
        token, ids, need = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((ids, token))
        token, ids, need = token[order], ids[order], need[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])
        token, ids, need = token[new], ids[new], need[new]
        same = token[1:] == token[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        return pa.RecordBatch.from_arrays(
            [pa.array(token[many].view(np.int64)), pa.array(ids[many]), pa.array(need[many].astype(np.int32))], names=["token", "id", "need"]
        )

    for batch in batches:
        for bucket, tokens, ids, needs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and bucket != last:
                yield close()
            last = bucket
            n = len(needs)
            token = np.zeros((n, 8), np.uint8)
            token[:, :TOKEN_BYTES] = np.frombuffer(tokens, np.uint8).reshape(-1, TOKEN_BYTES)
            # what the bucket says stands above the bytes that travel, as far as there is room
            high = U((bucket << (8 * TOKEN_BYTES)) & ((1 << 63) - 1))
            wide = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(8, -1).T).view("<i8").ravel()
            held.append((token.view("<u8").ravel() | high, wide, np.frombuffer(needs, np.uint8)))
    if held:
        yield close()


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def link_sets(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among `sets` that connect what all links connect.

    known: sets with equal numbers are connected already. guest: sets that are compared with the others, not with one another.
    """
    n = len(sets)
    lengths = np.array([len(s) for s in sets], np.int64)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    guest = np.zeros(n, bool) if guest is None else guest
    # similar sets side by side: by what is known of them and their smallest hashes
    first = [(bool(guest[i]), int(known[i]) if known is not None else 0, *s[:3].tolist()) for i, s in enumerate(sets)]
    order = sorted(range(n), key=first.__getitem__)
    hosts = [i for i in order if not guest[i]]
    row_of = np.full(n, -1)
    row_of[hosts] = np.arange(len(hosts)) // ROW
    rows = -(-len(hosts) // ROW)
    if not rows:
        return []
    members = [np.array(hosts[r * ROW : (r + 1) * ROW]) for r in range(rows)]
    # the matrix: for each token the rows whose union has it
    row_of_flat = row_of[np.repeat(np.arange(n), lengths)]
    cells = np.unique((flat * rows + row_of_flat)[row_of_flat >= 0])
    cell_row, cell_begin = cells % rows, np.searchsorted(cells // rows, np.arange(len(tokens) + 1))
    row_begin = [np.concatenate([[0], np.cumsum(lengths[m])]) for m in members]
    row_flat = [np.concatenate([flat[begin[i] : begin[i + 1]] for i in m]) for m in members]
    forest, links, mark = Forest(n), [], np.zeros(len(tokens), bool)
    if known is not None:
        lead: dict[int, int] = {}
        for i, k in enumerate(known.tolist()):
            forest.join(lead.setdefault(k, i), i)
    row_one = np.zeros(rows, bool)  # all members are connected

    def settle(r: int) -> None:
        root = forest.root(int(members[r][0]))
        row_one[r] = all(forest.root(int(j)) == root for j in members[r])

    for r in range(rows):
        settle(r)
    for i in order:
        mine = flat[begin[i] : begin[i + 1]]
        at, size = cell_begin[mine], cell_begin[mine + 1] - cell_begin[mine]
        places = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at, size)
        bound = np.bincount(cell_row[places], minlength=rows)
        mark[mine] = True
        for r in np.flatnonzero(100 * bound >= percent * len(mine)).tolist():
            if r < row_of[i]:
                continue
            m = members[r]
            if row_one[r] and forest.root(i) == forest.root(int(m[0])):
                continue
            common = np.add.reduceat(mark[row_flat[r]].astype(np.int64), row_begin[r][:-1])
            union = lengths[m] + len(mine) - common
            for j in m[(100 * common >= percent * union) & (m != i)].tolist():
                if forest.join(i, j):
                    links.append((i, j))
            if not row_one[r]:
                settle(r)
        mark[mine] = False
    return links


def sets_of_rows(rows: pd.DataFrame, size: int) -> list[np.ndarray]:
    return [s for piece in pieces(pa.array(rows["text"], pa.large_string(), from_pandas=True)) for s in sets_of(piece, size)]


def links_of(rows: pd.DataFrame, links: list[tuple[int, int]]) -> pd.DataFrame:
    ids = rows["id"].to_numpy()
    return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"]).astype("int64")


def follow_unit(rows: pd.DataFrame, size: int, percent: int) -> pd.DataFrame | None:
    """Links between one set (`known` 0) and its followers."""
    if len(rows) < 2:
        return None
    sets, links = sets_of_rows(rows, size), []
    heads = np.flatnonzero(rows["known"].to_numpy() == 0).tolist()
    for h in heads:
        for i, s in enumerate(sets):
            if i != h and len(s) and len(sets[h]):
                common = len(np.intersect1d(sets[h], s, assume_unique=True))
                if 100 * common >= percent * (len(sets[h]) + len(s) - common):
                    links.append((h, i))
    return links_of(rows, links)


def block_unit(rows: pd.DataFrame, size: int, percent: int) -> pd.DataFrame | None:
    """Links within a block, or between a block and its guests."""
    if len(rows) < 2:
        return None
    sets = sets_of_rows(rows, size)
    full = [len(s) > 0 for s in sets]
    rows, sets = rows[full], [s for s in sets if len(s)]
    return links_of(rows, link_sets(sets, percent, rows["known"].to_numpy(), rows["guest"].to_numpy())) if sets else None


def compared(slim: DataFrame, asked: DataFrame, each, name: str) -> DataFrame:
    """(a, b): the links that `each` finds in the units of asked (id, unit, known, guest), a written table.

    Texts that nobody asks for are dropped where they are read, by Spark's Bloom filter as far as its bounded size goes.
    """
    work = slim.join(asked.where("unit >= 0"), "id").select("unit", "known", "guest", "id", "text")
    return materialize(map_runs(work, "unit", each, "a bigint, b bigint"), name, SMALL_BATCHES | BLOOM)


def numbered(*columns: str):
    """A unit's number, 62 bits from what names it."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def candidates(tokens: DataFrame) -> DataFrame:
    """(token, id, need, kept) from (token, id, need): kept leaves out the need - 1 most frequent tokens of each id.

    Linked sets share need tokens at least, so whatever each of them leaves out by one common order, they still share one.
    """
    size = tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1")
    rows = tokens.join(size, "token").withColumn("class", F.col("token").bitwiseAND(F.lit(1)))
    own = Window.partitionBy("id", "class")
    rank = F.row_number().over(own.orderBy(F.desc("size"), "token"))
    least = F.min("need").over(own)
    return rows.select("token", "id", least.alias("need"), (rank >= least).alias("kept"))


def most_shared(tokens: DataFrame) -> DataFrame:
    """(a, b, n): for each token's ids its smallest one as a, with the number of tokens that make them meet. One row for each token and id at most."""
    heads = tokens.groupBy("token").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("token", "a")
    pairs = tokens.join(heads, "token").where("id <> a").select("a", F.col("id").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def followers(stars: DataFrame) -> DataFrame:
    """Units (id, unit, known, guest) that hold each b of (a, b, n) against the a with the most tokens in common."""
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("minus"))).alias("x")).select("b", (-F.col("x.minus")).alias("a"))
    many = best.groupBy("a").agg(F.ceil(F.count("*") / FOLLOWERS).cast("int").alias("units"))
    own = best.join(many, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("units")).cast("int").alias("u"), F.lit(1).alias("known"))
    heads = many.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("u"), F.lit(0).alias("known"))
    return own.unionByName(heads).select("id", numbered("a", "u").alias("unit"), F.col("known").cast("long"), F.lit(False).alias("guest"))


def blocks(groups: DataFrame, sizes: DataFrame, tokens: DataFrame) -> DataFrame:
    """Units (id, unit, known, guest) for the groups (id, g, known) that are not connected yet.

    A group that fits is one block. Of others the largest connected class (side 1) and the rest (side 2) are cut into blocks apart. Sets of the
    rest are guests in every block of the largest class, and in those of the rest before their own, if the tokens of other classes in the block's
    union are as many of theirs as a link needs.
    """
    classes = groups.groupBy("g", "known").agg(F.count("*").alias("k"))
    main = classes.groupBy("g").agg(F.max(F.struct("k", F.col("known").alias("main"))).alias("x"), F.count("*").alias("classes"))
    rows = groups.join(main.where("classes > 1").select("g", F.col("x.main").alias("main")), "g").join(sizes, "id")
    rows = rows.withColumn("inside", F.when(F.col("known") == F.col("main"), F.col("n")).otherwise(0))
    total = rows.groupBy("g").agg(F.sum("n").alias("all"), F.sum("inside").alias("within"))
    rows = rows.join(total, "g")
    rows = rows.withColumn("side", F.when(F.col("all") <= BLOCK_SHINGLES, 0).when(F.col("inside") > 0, 1).otherwise(2))
    weight = F.when(F.col("side") == 1, F.col("within")).when(F.col("side") == 2, F.col("all") - F.col("within")).otherwise(1)
    block = F.pmod(F.xxhash64("id"), F.ceil(weight / BLOCK_SHINGLES)).cast("int")
    rows = materialize(rows.select("id", "g", "known", "n", "side", block.alias("block")), "members")
    place = ["g", "side", "block"]
    hosts = rows.select("id", numbered(*place).alias("unit"), "known", F.lit(False).alias("guest"))

    wide = tokens.join(rows.where("side > 0"), "id").select("token", "id", "need", "known", *place)
    union = wide.groupBy("token", *place).agg(F.min("known").alias("low"), F.max("known").alias("high"))
    union = union.select(F.col("token").alias("t"), F.col("g").alias("hg"), F.col("side").alias("hside"), F.col("block").alias("hblock"), "low", "high")
    earlier = (F.col("hside") == 1) | (F.col("hblock") < F.col("block"))
    foreign = (F.col("low") != F.col("known")) | (F.col("high") != F.col("known"))
    met = wide.where("side = 2").join(union, (F.col("token") == F.col("t")) & (F.col("g") == F.col("hg")) & earlier & foreign)
    bound = met.groupBy("id", "known", "g", "hside", "hblock", "need", F.col("token").bitwiseAND(F.lit(1))).agg(F.count("*").alias("overlap"))
    there = ["g", F.col("hside").alias("side"), F.col("hblock").alias("block")]
    guests = bound.where("overlap >= need").select("id", "known", *there).distinct().join(sizes, "id")
    guests = materialize(guests, "guests")
    calls = guests.groupBy(*place).agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("calls"))
    guests = guests.join(calls, place).withColumn("call", F.pmod(F.xxhash64("id"), F.col("calls")).cast("int"))
    again = rows.join(calls, place).withColumn("call", F.explode(F.sequence(F.lit(0), F.col("calls") - 1)))
    called = numbered(*place, "call").alias("unit")
    guests = guests.select("id", called, "known", F.lit(True).alias("guest"))
    return hosts.unionByName(again.select("id", called, "known", F.lit(False).alias("guest"))).unionByName(guests)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", size: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs (id, text).

    A set holds the distinct shingles of `size` words, A-Z lowered; a text with fewer words has them as its only shingle. Texts link when 100 *
    intersection >= percent * union; the component is the smallest id that links reach. Null and empty texts, and texts without words, have an empty
    set and are linked with nothing; so is a row with a null id, whose component is null. Rows that share an id are one node. A text may have any
    length: it is one set. Other columns are ignored. An empty table gives no rows.

    What is shuffled: tokens, about a quarter (at 80 percent; a tenth at 90) of the shingles, each once for all equal sets that a task has
    gathered; the few that several sets share once more; and texts: each text that meets a near one once for that, those of groups that this doesn't connect
    once for their block and once for each block that they are guests of. A block and its guests have a bounded number of shingles.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    about = materialize(slim.mapInArrow(lambda it: describe(it, size), "id bigint, n bigint, fp bigint, hot bigint, texts bigint"), "sets")
    sets = about.where("n is not null").select("id", "n", "fp")
    common = about.where("hot is not null").groupBy("hot").agg(F.sum("texts").alias("texts")).orderBy(F.desc("texts"), "hot").limit(HOT_MOST)
    hot = np.sort(np.array([r[0] for r in common.select("hot").collect()], np.int64).view(U))  # at most HOT_MOST numbers
    full = sets.where("n > 0 and id is not null")
    shingles = full.agg(F.sum("n")).first()[0] or 0
    bits = min(40, max(0, math.ceil(math.log2(max(1, shingles / 3 / BUCKET_TOKENS)))))

    emitted = slim.mapInArrow(lambda it: emit_tokens(it, size, percent, hot, bits), "bucket bigint, tokens binary, ids binary, needs binary")
    shared = emitted.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(shared_tokens, "token bigint, id bigint, need int")
    # equal sets are one from here on, the one with the smallest id
    same = materialize(full.groupBy("n", "fp").agg(F.min("id").alias("rep")), "sets")
    alias = materialize(full.join(same, ["n", "fp"]).select("id", "rep").distinct(), "sets")
    sizes = same.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    tokens = shared.join(alias, "id").groupBy("token", F.col("rep").alias("id")).agg(F.min("need").alias("need"))
    tokens = materialize(candidates(materialize(tokens, "tokens")), "tokens")

    stars = materialize(most_shared(tokens.where("kept")), "stars")
    groups = materialize(components(stars.select("a", "b"), "groups").select("id", F.col("component").alias("g")), "groups")
    near = compared(slim, materialize(followers(stars), "units"), lambda rows: follow_unit(rows, size, percent), "links")
    known = components(near, "links").select("id", F.col("component").alias("known"))
    groups = materialize(groups.join(known, "id", "left").select("id", "g", F.coalesce("known", "id").alias("known")), "groups")
    units = materialize(blocks(groups, sizes, tokens), "units")
    rest = compared(slim, units, lambda rows: block_unit(rows, size, percent), "links")
    equal = alias.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    linked = components(near.unionByName(rest).unionByName(equal), "links").select("id", "component")
    out = sets.join(linked, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)
