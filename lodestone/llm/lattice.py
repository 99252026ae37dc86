"""SentencePiece encoding and decoding as a relational lattice.

Words are exploded into their substrings, of the sizes that pieces with the same first
characters have; an equi-join with the piece table leaves the edges of the words' lattices; they
are grouped by word, and a higher-order aggregate folds the Viterbi recursion over their ends.
The best paths are exploded again and joined with the piece table by id, which decodes them. The
piece table is broadcast; its size is the vocabulary's, MAX_PIECES at most. Pieces that shorter
ones always spell with a better score are left out of it, which changes no best path.

Words that many documents have are encoded once for all: those of a part of the documents of
about SAMPLE_BYTES, the MAX_COMMON most frequent at most. Which words these are changes no
result. They have numbers, and so has every other word within its group of about GROUP_BYTES of
text; texts become sequences of numbers, in the one pass that cuts them into words. A group's own words go the same way through the lattice, once for each group,
and the sequences then look their numbers up. Numbers and the groups' own words are written in
buckets of groups, so that neither is shuffled.

A word of any length goes this way. It is exploded window by window of WINDOW characters, and
the fold carries the scores of the last places that a piece can reach back to, BLOCK by BLOCK.
Memory is in proportion to the word, and so is time up to some 100,000 characters. A text is
never cut apart between groups.

Decoding explodes ids, joins them with the piece table and puts the pieces together in order.

Defined cases: a null or empty text has no ids and decodes to the empty text. Repeated rows and
null ids keep a row each. Other columns than doc_id and text are ignored, whatever their names.
A text that has the mark itself decodes to a blank there, so ``decoded`` is false for it.
"""

from __future__ import annotations

import contextlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, column, delete, drop, keep, setting, shared_dir
from lodestone.llm.pieces import MARK, WORDS, marked, needed, read

GROUP_BYTES = 8 << 20
SAMPLE_BYTES = 96 << 20
MAX_COMMON = 1 << 19
MAX_PIECES = 1 << 20
#: Words that are looked up at once.
PORTION = 200_000
WINDOW = 64
BLOCK = 256
cuts = re.compile(WORDS).finditer


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, score) of the pieces that best paths may use; its size is the vocabulary's at most."""
    if len(read(model).scores) > MAX_PIECES:
        raise ValueError("the vocabulary is too large to broadcast")
    return spark.createDataFrame([(p, i, s) for p, (i, s) in needed(model).items()], "piece string, id long, score double")


def head_table(spark: SparkSession, model: str) -> DataFrame:
    """(head, sizes): how long the pieces are that begin with three characters, 1 and 2 included; no larger than the table of pieces."""
    sizes: dict[str, set[int]] = {}
    for piece in needed(model):
        if len(piece) > 2:
            sizes.setdefault(piece[:3], {1, 2}).add(len(piece))
    return spark.createDataFrame([(h, sorted(x)) for h, x in sizes.items()], "head string, sizes array<int>")


def name_table(spark: SparkSession, model: str) -> DataFrame:
    """(id, raw): the bytes, in hexadecimal, that an id stands for."""
    pieces = read(model)
    if len(pieces.names) > MAX_PIECES:
        raise ValueError("the vocabulary is too large to broadcast")
    first = pieces.byte_ids[0]
    raw = [bytes([i - first]) if first <= i < first + 256 else n.encode("utf-8") for i, n in enumerate(pieces.names)]
    return spark.createDataFrame([(i, x.hex()) for i, x in enumerate(raw)], "id int, raw string")


def text_words(text: Column) -> Column:
    """Words of a text with the marks before them."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(MARK), F.replace(t, F.lit(" "), F.lit(MARK))), F.lit(WORDS), F.lit(0)))


def edges(rows: DataFrame, model: str) -> DataFrame:
    """(g, at, word, e, back, score, node) of rows(g, at, word): the piece that ends at place e of the word.

    ``back`` is less the longer the piece is, ``node`` its id times 64, plus its length. For a
    single character that is no piece, the id is -1 less the number that its bytes make. Only the
    first place's single character carries the word, so that long words aren't copied.
    """
    pieces, longest = read(model), max(map(len, needed(model)))
    if longest >= 64:
        raise ValueError("a piece is too long")
    n = F.length("word")
    wide = rows.select("g", "at", "word", F.explode_outer(F.sequence(F.lit(0), n - 1, F.lit(WINDOW))).alias("base"))
    wide = wide.select("g", "at", "word", "base", (n - F.col("base")).alias("left"), F.substring(F.col("word"), F.col("base") + 1, F.lit(WINDOW + longest)).alias("part"))
    starts = wide.withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.least(F.col("left"), F.lit(WINDOW)) - 1)))
    starts = starts.withColumn("head", F.substring(F.col("part"), F.col("i") + 1, F.lit(3))).join(F.broadcast(head_table(rows.sparkSession, model)), "head", "left")
    ends = starts.withColumn("size", F.explode_outer(F.coalesce("sizes", F.array(F.lit(1), F.lit(2))))).where("size <= left - i")
    parts = ends.withColumn("piece", F.substring(F.col("part"), F.col("i") + 1, F.col("size")))
    met = parts.join(F.broadcast(piece_table(rows.sparkSession, model)), "piece", "left").where("id IS NOT NULL OR size = 1")
    s = F.col("base") + F.col("i")
    odd = F.lit(-1) - F.conv(F.hex("piece"), 16, 10).cast("long")
    return met.select(
        "g", "at", F.when((s == 0) & (F.col("size") == 1), F.col("word")).alias("word"), (s + F.col("size")).alias("e"), F.col("size"), 
        F.coalesce("score", F.lit(pieces.unknown)).alias("score"), (F.coalesce("id", odd) * 64 + F.col("size")).alias("node"),
    )


def fold(lattice: str, longest: int) -> str:
    """SQL of the best path's ids. lattice is sorted by (e, back) and has an edge to each place from the one before it, the last of those that end there.

    ``last`` has the scores of the places before e, nearest last, and ``best`` and ``node`` what is
    known of e; of equal scores the piece that begins earlier stays. An aggregate copies what it
    carries at each step, so both the recursion and the walk back go block by block and hand on
    what a block has made.
    """
    here = "a.last[size(a.last) - x.size] + x.score"
    better = f"IF({here} > a.best, named_struct('e', a.e, 'best', {here}, 'node', x.node, 'last', a.last, 'made', a.made), a)"
    before = "IF(x.size = 1, a.best, a.last[size(a.last) + 1 - x.size])"
    new = f"named_struct('e', x.e, 'best', {before} + x.score, 'node', x.node, 'last', array_append(a.last, a.best), 'made', array_append(a.made, a.node))"
    none, nones = "cast(array() as array<bigint>)", "cast(array() as array<array<bigint>>)"
    inner = f"named_struct('e', o.e, 'best', o.best, 'node', o.node, 'last', o.last, 'made', {none})"
    recent = f"slice(a.last, greatest(1, size(a.last) - {longest}), {longest + 1})"
    block = f"aggregate(slice({lattice}, k * {BLOCK} + 1, {BLOCK}), {inner}, (a, x) -> IF(x.e = a.e, {better}, {new}), a -> named_struct('e', a.e, 'best', a.best, 'node', a.node, 'last', {recent}, 'done', concat(o.done, array(a.made))))"
    start = f"named_struct('e', 0, 'best', 0D, 'node', 0L, 'last', cast(array() as array<double>), 'done', {nones})"
    nodes = f"aggregate(sequence(0, (size({lattice}) - 1) div {BLOCK}), {start}, (o, k) -> {block}, o -> array_append(flatten(o.done), o.node))"
    walk = "IF(a.at = 0, a, named_struct('at', a.at - cast(b[a.at] & 63 as int), 'made', array_append(a.made, shiftright(b[a.at], 6))))"
    back = f"aggregate(sequence(1, least({BLOCK}, o.at)), named_struct('at', o.at, 'made', {none}), (a, i) -> {walk}, a -> named_struct('at', a.at, 'done', concat(o.done, array(a.made))))"
    path = f"aggregate(sequence(0, size(b) div {BLOCK}), named_struct('at', size(b) - 1, 'done', {nones}), (o, k) -> IF(o.at = 0, o, {back}), o -> reverse(flatten(o.done)))"
    return f"transform(array({nodes}), b -> {path})[0]"


def spelt(ids: str, first: int) -> str:
    """SQL of an array of ids as integers, with the bytes' ids in place of characters that are no piece."""
    size = "IF(i >= -256, 1, IF(i >= -65536, 2, IF(i >= -16777216, 3, 4)))"
    raw = f"transform(reverse(sequence(0, {size} - 1)), k -> cast(shiftright(-1 - i, 8 * k) & 255 as int) + {first})"
    return f"IF(array_min({ids}) >= 0, cast({ids} as array<int>), flatten(transform({ids}, i -> IF(i >= 0, array(cast(i as int)), {raw}))))"


def encode_words(rows: DataFrame, model: str) -> DataFrame:
    """(g, at, word, ids, same) of rows(g, at, word), distinct in (g, at), which stay in their partitions of g; same: the ids decode to the word."""
    pieces = read(model)
    lattice = F.sort_array(F.collect_list(F.struct("e", (-F.col("size")).alias("less"), "score", "node", "size"))).alias("lattice")
    word = F.get(F.collect_list("word"), F.lit(0)).alias("word")
    held = edges(rows, model).groupBy("g", "at").agg(lattice, word)
    paths = held.select("g", "at", "word", F.expr(fold("lattice", max(map(len, needed(model))))).alias("path"))
    found = paths.select("g", "at", "word", F.expr(spelt("path", pieces.byte_ids[0])).alias("ids"))
    each = found.select("g", "at", "word", F.posexplode_outer("ids").alias("place", "id")).join(F.broadcast(name_table(rows.sparkSession, model)), "id")
    each = each.withColumn("word", F.when(F.col("place") == 0, F.col("word")))
    back = each.groupBy("g", "at").agg(F.sort_array(F.collect_list(F.struct("place", "id", "raw"))).alias("p"), word)
    return back.select("g", "at", "word", F.col("p.id").alias("ids"), (F.decode(F.unhex(F.array_join("p.raw", "")), "UTF-8") == F.col("word")).alias("same"))


def common_words(docs: DataFrame, model: str, total: int, parts: int, most: int = MAX_COMMON) -> tuple[dict[str, int], list[bytes], list[int]]:
    """Words of a part of the documents, numbered with the most frequent first, most at most; their ids by number; and the numbers of those that don't decode to themselves.

    The ids come from the lattice, as all ids do. Words of equal frequency are taken or left together.
    """
    part = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(max(1, total // SAMPLE_BYTES))) == 0)
    counted = keep(part.select(F.explode(F.array_distinct(text_words(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    least, held = None, 0
    for times, n in counted.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        held += n
        if held > most:
            break
        least = times
    if least is None:
        return {}, [], []
    chosen = counted.where(F.col("n") >= least)
    dealt = chosen.select(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("g"), F.col("n").alias("times"), "word").repartition(parts, "g")
    each = dealt.withColumn("at", F.monotonically_increasing_id()).select("g", "at", "word")
    rows = encode_words(each, model).select("word", "ids", "same").join(chosen, "word").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    drop(counted)
    numbers = {w: i for i, w in enumerate(rows.column("word").to_pylist())}
    return numbers, raw_ids(rows.column("ids")), [i for i, same in enumerate(rows.column("same").to_pylist()) if not same]


def raw_ids(column) -> list[bytes]:
    """Each list of ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    held = column.combine_chunks()
    raw = np.asarray(held.flatten().to_numpy(zero_copy_only=False), "<u4").tobytes()
    ends = [0, *(4 * np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False), dtype="i8")).tolist()]
    return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]


class Numbers(dict):
    """Numbers of words; a word that has none gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed(numbers) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first, which compresses better."""
    import pyarrow as pa

    return pa.compress(numbers.view("u1").reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int):
    import numpy as np
    import pyarrow as pa

    return np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), "u1").reshape(4, n).T.copy().view("<u4").ravel()


NUMBERED = "g long, doc_ids array<long>, n_words array<long>, plain array<boolean>, numbers binary, words array<string>"


def numbered(docs: DataFrame, common, group_bytes: int) -> DataFrame:
    """NUMBERED of docs(doc_id, text), a row for each group: its texts as numbers of words, one after the other, and the words that aren't common, whose numbers follow the common ones'.

    ``plain`` is whether a text is what its words spell, once each of them is decoded to itself.
    """

    def group(at: int, docs: list[tuple], held: list, own: Numbers, n_common: int):
        import numpy as np
        import pyarrow as pa

        ids, n, plain = zip(*docs, strict=True)
        g = (TaskContext.get().partitionId() << 32) + at
        cols = [[g], [list(ids)], [list(n)], [list(plain)], [packed(np.concatenate(held))], [list(islice(own, n_common, None))]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in NUMBERED.split(", ")])

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        known = common.value[0]
        at, size, docs, held, own = 0, 0, [], [], Numbers(known)
        for b in batches:
            for doc_id, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                text = text or ""
                if docs and size + len(text) > group_bytes:
                    yield group(at, docs, held, own, len(known))
                    at, size, docs, held, own = at + 1, 0, [], [], Numbers(known)
                whole, n, spelt_to = marked(text), 0, 0
                found = cuts(whole)
                while words := [m[0] for m in islice(found, PORTION)]:
                    held.append(np.fromiter(map(own.__getitem__, words), "<u4", len(words)))
                    n += len(words)
                    spelt_to += len("".join(words))
                held.append(np.zeros(0, "<u4"))
                docs.append((doc_id, n, spelt_to == len(whole) and MARK not in text))
                size += len(text)
        if docs:
            yield group(at, docs, held, own, len(known))

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, NUMBERED)


def looked_up(left, right, common: tuple[dict[str, int], list[bytes], list[int]], with_ids: bool):
    """Ids of a group's texts from those of its words."""
    import numpy as np
    import pyarrow as pa

    right = right.sort_by("at")
    if right.column("at").to_pylist() != list(range(left.column("n_own")[0].as_py())):
        raise ValueError("a word of a group has no ids")
    raw = common[1] + raw_ids(right.column("ids"))
    odd = common[2] + [len(common[1]) + i for i, same in enumerate(right.column("same").to_pylist()) if not same]
    doc_ids, n_words, plain = (left.column(c)[0].as_py() for c in ("doc_ids", "n_words", "plain"))
    numbers = unpacked(left.column("numbers")[0].as_py(), sum(n_words))
    at, out, n, crc, decoded = 0, [], [], [], []
    for k, whole in zip(n_words, plain, strict=True):
        n.append(0)
        crc.append(0)
        for i in range(at, at + k, PORTION):
            ids = b"".join(map(raw.__getitem__, numbers[i : min(i + PORTION, at + k)].tolist()))
            n[-1] += len(ids) // 4
            crc[-1] = zlib.crc32(ids, crc[-1])
            if with_ids:
                out.append(ids)
        decoded.append(whole and not (odd and np.isin(numbers[at : at + k], odd).any()))
        at += k
    cols = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "decoded": pa.array(decoded, pa.bool_())}
    if with_ids:
        ends = np.cumsum([0, *n])
        cols["ids"] = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(out), "<i4"))).cast(pa.list_(pa.int32()))
    return pa.table(cols)


@contextlib.contextmanager
def bucketed(rows: DataFrame, parts: int) -> Iterator[DataFrame]:
    """rows in buckets of g, as a table in the shared folder while the block runs: all that goes by g reads it without a shuffle."""
    spark, name = rows.sparkSession, f"lodestone_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        rows.write.format("parquet").bucketBy(parts, "g").option("path", path).saveAsTable(name)
        try:
            yield spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")
            delete(spark, path)


def encode(docs: DataFrame, model: str, group_bytes: int = GROUP_BYTES, with_ids: bool = True, most: int = MAX_COMMON) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded, ids) of docs(doc_id, text): ids of the best segmentation, a checksum of them as little-endian unsigned 32-bit integers, and whether they give the text back.

    The result is written to the shared folder, without ids if they aren't wanted.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Edges come word by word: sorted aggregation takes one pass over them, and no second buffer.
    with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):
        common = spark.sparkContext.broadcast(common_words(docs, model, total, max(1, -(-min(total, SAMPLE_BYTES) // (4 << 20))), most))
        parts = max(1, -(-total // group_bytes)) * 2
        fields = "doc_id long, n_tokens long, ids_crc32 long, decoded boolean" + ", ids array<int>" * with_ids
        with bucketed(numbered(docs, common, group_bytes), parts) as groups:
            own = groups.select("g", F.posexplode("words").alias("at", "word"))
            table = encode_words(own, model).select(F.col("g").alias("h"), "at", "ids", "same")
            texts = groups.select("g", "doc_ids", "n_words", "plain", "numbers", F.size("words").alias("n_own")).groupBy("g")
            return keep(texts.cogroup(table.groupBy("h")).applyInArrow(lambda left, right: looked_up(left, right, common.value, with_ids), fields), "lattice")


def decode(rows: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows(key, ids), with distinct keys: the inverse of encoding, by a join with the piece table."""
    each = rows.select(key, F.posexplode("ids").alias("at", "id")).join(F.broadcast(name_table(rows.sparkSession, model)), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "")
    joined = each.groupBy(key).agg(F.decode(F.unhex(text), "UTF-8").alias("text"))
    made = rows.select(key).join(joined, key, "left")
    return made.select(key, F.coalesce(F.expr(f"substring(replace(text, '{MARK}', ' '), 2)"), F.lit("")).alias("text"))


def op7_relational_lattice(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, as their number and checksum, and whether they decode to the text."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
