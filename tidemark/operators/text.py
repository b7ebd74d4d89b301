"""Text to terms, facts and clusters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that are no terms.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "was", "are", "der", "die", "das", "und", "les", "des", "que", "los", "las", "para")
TOKEN = r"[A-Za-z][A-Za-z0-9]{2,}"
#: Entities that markup must escape.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Query parameters that only track.
TRACKING = "(?i)^(utm_|spm|from)"
#: Words that part phrases, as they say nothing of their own.
PHRASE_STOPS = (
    "公司 股份 有限 有限公司 股份有限公司 公告 今日 昨日 近日 投资 投资者 市场 股票 证券 股东 董事 会议 本次 相关 关于 方面 进行 持续 积极 实现 表示 目前 未来 发展 业务 产品 我们 企业 已经 通过 以及 以上 以下 是否 感谢 问题 回答 年度 报告 可以 可能 预计 据悉 记者 消息 财联社 东方财富 同花顺 新闻 涨停 下跌 上涨 "
    "合成 演示 场景 固定 示例 文本 本条 对应 不对应 真实 实际 同时 共同 进入 阶段 信息 说明 记录 数据 来源 文章 转发 评论 本文 此次 最近 有关 进一步 其中 因此 此前 正在 此后 开始 取得 达到 继续 完成 开展 新的 不是 和 与 的 在 了 为 从 至 到 将 已 对 向 由 或 等 其 这 本"
).split()
#: Letters of which phrases are made, and the lengths of phrases.
PHRASE_LETTERS, SHORTEST, LONGEST = "\u4e00-\u9fff", 2, 8


def clean(html: Column) -> Column:
    """Text without tags, entities resolved, white space folded."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def canonical_url(url: Column) -> Column:
    """Host in lower case, no parameters that track or are empty, no fragment, no slash at the end."""
    kept = F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda x: x.rlike("^[^=]+=.") & ~x.rlike(TRACKING))
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    return F.regexp_replace(F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.lower(F.parse_url(url, F.lit("HOST"))), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")), "/+$", "")


def exact_key(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(text), r"\s+", ""), 256)


def tokens(text: Column) -> Column:
    """ASCII terms of three characters or more in lower case, without stop words, in order, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t)), lambda t: ~t.isin(*STOP_WORDS))


def grams(words: Column, n: int) -> Column:
    """n words in a row, joined by a blank: the words beside those one, two ... places on."""
    held = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), held)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, k + 1, held), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def char_grams(text: Column, n: int) -> Column:
    """Every n characters in a row, found in one pass: each find looks ahead n characters and takes one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))


def span_grams(text: Column, stops: tuple[str, ...] | list[str] = tuple(PHRASE_STOPS), letters: str = PHRASE_LETTERS, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Distinct runs of `shortest` to `longest` letters of the text's spans, which end at other characters and at stop words, longer ones cut out first."""
    parted = text
    for stop in sorted(set(stops), key=lambda x: (-len(x), x)):
        parted = F.replace(parted, F.lit(stop), F.lit(" "))
    spans = F.regexp_extract_all(parted, F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0))
    cut = lambda span, n: F.transform(F.sequence(F.lit(1), F.length(span) - n + 1), lambda i: F.substring(span, i, n))
    of_span = lambda span: F.flatten(F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(span))), lambda n: cut(span, n)))
    return F.array_distinct(F.flatten(F.transform(spans, of_span)))


def prune_substrings(terms: DataFrame, factor: float, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Terms (term, n) without those inside a longer term that stays and that explains them: whose n times `factor` reaches theirs.

    From the longest to the shortest length; each length looks up its terms among
    the parts of longer ones that stay. `keep` writes a round's rows, so that the
    plan of the next begins there. Lengths are few, rows stay in Spark.
    """
    sized = keep(terms.select("term", "n", F.length("term").alias("size")))
    lengths = sorted((r["size"] for r in sized.select("size").distinct().collect()), reverse=True)
    stays = sized.where("false")
    for size in lengths:
        parts = stays.select(F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - size + 1), lambda i: F.substring("term", i, F.lit(size)))).alias("term"), F.col("n").alias("longer"))
        most = parts.groupBy("term").agg(F.max("longer").alias("longer"))
        own = sized.where(F.col("size") == size).join(most, "term", "left")
        stays = keep(stays.unionByName(own.where(F.col("longer").isNull() | (F.col("n") > factor * F.col("longer"))).drop("longer")))
    return stays.select("term", "n")


#: Bytes of text whose terms are counted together in a task.
BLOCK = 1 << 23
#: Sources that are bits of one number; of more sources a term has a row for each.
MOST_BITS = 63
#: Terms, parts and texts of a block are numbered together below this.
MOST_PLACES = 1 << 63
#: Each byte as terms see it: letters in lower case, digits, anything else a blank.
PLAIN = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def text_ends(text: pa.StringArray) -> np.ndarray:
    """Where the first text begins in the array's bytes, and where each ends."""
    return np.frombuffer(text.buffers()[1] or bytes(4), np.int32)[text.offset : text.offset + len(text) + 1]


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of the batches in blocks that hold `size` bytes of text and at most one text more."""
    held, full = [], 0
    for batch in batches:
        ends, at = text_ends(batch.column("text")), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + size - full, "right")) - 1)
            held.append(batch.slice(at, end - at))
            full += int(ends[end] - ends[at])
            at = end
            if full >= size:
                yield pa.concat_batches(held)
                held, full = [], 0
    if held:
        yield pa.concat_batches(held)


def block_counts(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(term, part, n_recent, n_past, bits) of a block of (text, part, recent, past, bit): `tokens` and pairs of them, once a text, by term and part.

    Words are numbered, a pair is a number of two, and one sort of these with the
    part and the place of the text behind them brings equal ones together.
    """
    text, rows = block.column("text"), block.num_rows
    ends = text_ends(text)
    plain = memoryview(text.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes().translate(PLAIN)
    runs = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)]))
    row = pc.list_parent_indices(runs).to_numpy().astype(np.int64)
    runs = pc.list_flatten(runs).dictionary_encode()
    # A term begins at the first letter of its run.
    begun = pc.ascii_ltrim(runs.dictionary, "0123456789").dictionary_encode()
    words, part = begun.dictionary, block.column("part").dictionary_encode("encode")
    is_term = pc.and_not(pc.greater_equal(pc.binary_length(words), 3), pc.is_in(words, pa.array(STOP_WORDS))).to_numpy(zero_copy_only=False)
    code = begun.indices.to_numpy()[runs.indices.to_numpy()].astype(np.int64)
    row, code = row[is_term[code]], code[is_term[code]]
    n, parts = len(words), len(part.dictionary)
    if rows > 1 and (n + 1) * n * parts * rows > MOST_PLACES:
        yield from block_counts(block.slice(0, rows // 2))
        yield from block_counts(block.slice(rows // 2))
        return
    beside = row[1:] == row[:-1]
    term = np.concatenate([code, (code[:-1][beside] + 1) * n + code[1:][beside]])
    row = np.concatenate([row, row[:-1][beside]])
    if not len(term):
        return
    place = np.sort((term * parts + part.indices.to_numpy()[row]) * rows + row)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    key = place // rows
    row = place - key * rows
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[first]
    term = key // parts
    alone = np.searchsorted(term, n)
    pairs = term[alone:]
    names = pa.concat_arrays([words.take(pa.array(term[:alone])), pc.binary_join_element_wise(words.take(pa.array(pairs // n - 1)), words.take(pa.array(pairs % n)), " ")])
    recent, past, bit = (block.column(c).to_numpy()[row] for c in ("recent", "past", "bit"))
    counts = [pa.array(np.add.reduceat(recent, first)), pa.array(np.add.reduceat(past, first)), pa.array(np.bitwise_or.reduceat(bit, first))]
    out = pa.table([names, part.dictionary.take(pa.array(key % parts)), *counts], ["term", "part", "n_recent", "n_past", "bits"])
    yield from out.to_batches(max_chunksize=1 << 16)


def phrase_counts(docs: DataFrame, id_column: str, text: str, source: str, recent: Column, least: int) -> DataFrame:
    """(term, n_recent, n_past, n_sources) of terms and pairs of terms in `least` recent documents at least, one or more.

    Each row is a document; repeats in it count once. Tasks count blocks of their texts, so a term that
    all documents hold is one row a block, and only one shuffle, by term, follows. Up to
    MOST_BITS sources are bits of a number; of more, rows are kept apart by source.
    """
    known = [r[0] for r in docs.select(source).where(F.col(source).isNotNull()).distinct().limit(MOST_BITS + 1).collect()]
    many = len(known) > MOST_BITS
    bit = F.col(source).isNotNull().cast("long") if many else F.coalesce(*[F.when(F.col(source) == s, F.lit(1 << k).cast("long")) for k, s in enumerate(known)], F.lit(0).cast("long"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    rows = docs.where(F.col(text) != "").select(
        F.col(text).alias("text"),
        (F.col(source) if many else F.lit(None)).cast("string").alias("part"),
        flag(recent).alias("recent"),
        flag(~recent).alias("past"),
        (flag(recent) * bit).alias("bit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK):
            yield from block_counts(block)

    each = rows.mapInArrow(run, "term string, part string, n_recent long, n_past long, bits long")
    sums = [F.sum("n_recent").alias("n_recent"), F.sum("n_past").alias("n_past")]
    if many:
        # A term's rows are in one partition, so neither count moves them again.
        by_source = each.repartition("term").groupBy("term", "part").agg(*sums, F.max("bits").alias("n_sources"))
        counts = by_source.groupBy("term").agg(*sums, F.sum("n_sources").alias("n_sources"))
    else:
        counts = each.drop("part").repartition("term").groupBy("term").agg(*sums, F.bit_count(F.bit_or("bits")).cast("long").alias("n_sources"))
    return counts.where(F.col("n_recent") >= least)


def pruned_phrases(terms: DataFrame, factor: float) -> DataFrame:
    """Terms left when one word is dropped whose support is at most `factor` times that of a pair that holds it."""
    pairs = terms.where(F.col("term").contains(" ")).select(F.explode(F.array_distinct(F.split("term", " "))).alias("term"), F.col("n_recent").alias("n_pair"))
    best = pairs.groupBy("term").agg(F.max("n_pair").alias("n_pair"))
    return terms.join(best, "term", "left").where(F.col("n_pair").isNull() | (F.col("n_recent") > factor * F.col("n_pair"))).drop("n_pair")


def match_terms(docs: DataFrame, dictionary: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, topic, hits): dictionary terms in each document; a topic whose `context` is set needs that word too.

    The document's words are looked up by hash, so no document meets every term; words that are neither a term nor a context
    drop out before anything is counted or shuffled, against a table that Spark broadcasts where its size allows.
    """
    known = dictionary.select(F.col("term").alias("word")).unionByName(dictionary.where("context is not null").select(F.col("context").alias("word"))).distinct()
    each = docs.select(id_column, F.explode(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda t: F.lower(t))).alias("word"))
    words = each.join(known, "word", "left_semi").groupBy(id_column, "word").agg(F.count(F.lit(1)).alias("hits"))
    found = words.join(dictionary, F.col("word") == F.col("term"))
    asked = found.where("context is null").select(id_column, "topic", "hits")
    bound = found.where("context is not null").join(words.select(id_column, F.col("word").alias("context")), [id_column, "context"], "left_semi").select(id_column, "topic", "hits")
    return asked.unionByName(bound).groupBy(id_column, "topic").agg(F.sum("hits").alias("hits"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(topic, ancestor) of (topic, parent): parents, their parents and so on; a cycle ends where it began. Paths double in length a round."""
    paths = parents.where("parent is not null").select("topic", F.col("parent").alias("ancestor")).distinct()
    n = paths.count()
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.topic")).select("a.topic", "b.ancestor")
        # The taxonomy is small and known rows are kept, so a round doesn't work out the ones before it again.
        paths = paths.sparkSession.createDataFrame(paths.unionByName(longer).distinct().collect(), paths.schema)
        if (m := paths.count()) == n:
            return paths.where("topic <> ancestor")
        n = m


#: Signs of text that are looked at together; the prefix by which terms are looked up.
STRETCH, PREFIX = 512, 3
#: Beginnings of terms that are tested in place, before any row is made; of larger dictionaries all places are joined.
MOST_BEGINS = 2000
#: Terms of a dictionary that is sent to all tasks, and bytes of them.
MOST_BROADCAST, MOST_TERM_BYTES = 100_000, 1 << 22
#: Bytes of text at which terms are begun together.
STEP = 1 << 18
WORD_TERM = r"[a-zA-Z0-9 $/\-]+"
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Trie:
    """Terms of one byte and more, sorted and distinct, as a trie of bytes. Edges are numbers, node * 256 + byte, in order; edge e leads to node e + 1."""

    def __init__(self, terms: list[bytes]):
        self.size = np.array([len(t) for t in terms], np.int64)
        letters, begin = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(self.size) - self.size
        levels, node, more, nodes = [], np.zeros(len(terms), np.int64), np.arange(len(terms)), 1
        ends = {}
        while len(more):
            level, place = np.unique(node[more] * 256 + letters[begin[more] + len(levels)], return_inverse=True)
            node[more] = nodes + place
            levels.append(level)
            nodes += len(level)
            done = self.size[more] == len(levels)
            ends |= dict(zip(node[more[done]].tolist(), more[done].tolist(), strict=True))
            more = more[~done]
        self.edges = np.concatenate([np.zeros(0, np.int64), *levels])
        #: The term that ends at a node, or -1.
        self.term = np.full(nodes, -1, np.int64)
        self.term[list(ends)] = list(ends.values())
        #: By two bytes: whether a term begins so.
        self.begins = np.zeros((256, 256), bool)
        if terms:
            first = levels[0]
            self.begins[first[self.term[1 : 1 + len(first)] >= 0]] = True
            second = levels[1] if len(levels) > 1 else first[:0]
            self.begins[first[second // 256 - 1], second % 256] = True
        self.begins = self.begins.reshape(-1)

    def places(self, data: np.ndarray, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, terms): where terms begin in data[start:end]; data is one byte longer than the text."""
        pairs = data[start:end].astype(np.uint16) << 8 | data[start + 1 : end + 1]
        at = start + np.flatnonzero(self.begins[pairs])
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            asked = node * 256 + data[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, asked), len(self.edges) - 1)
            there = self.edges[edge] == asked
            at, node, depth = at[there], edge[there] + 1, depth + 1
            term = self.term[node]
            yield at[term >= 0], term[term >= 0]
            inside = at + depth < len(data) - 1
            at, node = at[inside], node[inside]


def terms_in(text: pa.StringArray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, free): the terms that each text holds, once each; free, if somewhere no ASCII letter or digit is beside it.

    Terms are looked for in the bytes of all texts together: of UTF-8, equal bytes are equal signs.
    """
    ends = text_ends(text).astype(np.int64)
    data = np.frombuffer(memoryview(text.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes() + b"\0", np.uint8)
    ends -= ends[0]
    n, found = max(len(trie.size), 1), [np.zeros(0, np.int64)]
    for start in range(0, len(data) - 1, STEP):
        part = []
        for at, term in trie.places(data, start, min(start + STEP, len(data) - 1)):
            row, last = np.searchsorted(ends, at, "right") - 1, at + trie.size[term]
            own = last <= ends[row + 1]
            at, term, row, last = at[own], term[own], row[own], last[own]
            free = ~((at > ends[row]) & _ALNUM[data[at - 1]]) & ~((last < ends[row + 1]) & _ALNUM[data[last]])
            part.append((row * n + term) * 2 + ~free)
        found.append(np.unique(np.concatenate([found[0], *part])))
    # A free place of a term comes before its others.
    code = np.unique(np.concatenate(found))
    code = code[np.concatenate([[True], code[1:] >> 1 != code[:-1] >> 1])] if len(code) else code
    return (code >> 1) // n, (code >> 1) % n, code & 1 == 0


def known_places(docs: DataFrame, known: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, topic, term, beside) of the known terms (topic, term, inside, beside) in each text, by one pass of tasks over it with a trie of all terms."""
    spark, rows = docs.sparkSession, known.collect()
    terms = sorted({r["term"].encode() for r in rows})
    number = {t.decode(): i for i, t in enumerate(terms)}
    sent = spark.sparkContext.broadcast(Trie(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, free = terms_in(batch.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(term), pa.array(free)], names=[batch.schema.names[0], "number", "free"])

    lowered = docs.select(id_column, F.lower(text).alias("lowered"))
    held = lowered.mapInArrow(run, T.StructType([lowered.schema[0], T.StructField("number", T.LongType()), T.StructField("free", T.BooleanType())]))
    meant = spark.createDataFrame([(number[r["term"]], *r) for r in rows], T.StructType([T.StructField("number", T.LongType()), *known.schema]))
    # A text's terms are brought together once, for all that follows.
    return held.repartition(id_column).join(F.broadcast(meant), "number").where(F.col("inside") | F.col("free")).select(id_column, "topic", "term", "beside")


def joined_places(docs: DataFrame, known: DataFrame, id_column: str, text: str, least: int, most: int) -> DataFrame:
    """The same as `known_places` for a dictionary of any size, as a join.

    The text is cut into stretches that overlap by the longest term; each place whose few next signs begin some term is joined to the terms of
    that beginning and compared.
    """
    prefix = min(PREFIX, least)
    known = known.withColumn("prefix", F.substring("term", 1, prefix))
    # A sign before each stretch and after its longest term, to see what stands beside.
    window = STRETCH + 1 + most
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lit(rf"(?s)(?=(.{{1,{window + 1}}})).{{1,{STRETCH}}}"), F.lit(1))
    stretches = docs.select(id_column, F.explode(pieces).alias("s"))
    begins = known.select("prefix").distinct()
    places = F.transform(F.sequence(F.lit(2), F.least(F.length("s"), F.lit(STRETCH + 1))), lambda i: F.struct(i.alias("i"), F.substring("s", i, F.lit(prefix)).alias("prefix")))
    few = begins.limit(MOST_BEGINS + 1).collect()
    if len(few) <= MOST_BEGINS:
        places = F.filter(places, lambda x: x["prefix"].isin([r["prefix"] for r in few]))
    at = stretches.where(F.length("s") >= 2).select(id_column, "s", F.explode(places).alias("x")).select(id_column, "s", "x.i", "x.prefix")
    size_of = F.length("term")
    free = ~F.substring("s", F.col("i") - 1, F.lit(1)).rlike("[A-Za-z0-9]") & ~F.substring("s", F.col("i") + size_of, F.lit(1)).rlike("[A-Za-z0-9]")
    found = at.join(known, "prefix").where((F.substring("s", F.col("i"), size_of) == F.col("term")) & (F.col("inside") | free))
    return found.select(id_column, "topic", "term", "beside")


def match_anywhere(docs: DataFrame, dictionary: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, topic, how, terms): topics whose terms stand in a text, `explicit` with how many of their terms do, and their ancestors, `implied`, with none.

    dictionary: topic, term, inside, context, parent. Case doesn't count. A term with `inside` may stand anywhere, also within a word or in text without
    blanks; another one must have no ASCII letter or digit beside it. Null `inside`: whether the term has other signs than ASCII letters, digits, blanks
    and $/-. A topic with contexts needs one of them in the text too, found in the same way. Terms of one character count as well; empty ones don't.

    A dictionary of MOST_BROADCAST terms at most is sent to all tasks as a trie, and each text is gone through once, whatever the number of terms; a
    larger one is joined to the places of texts by shuffles. It is never a product of texts and terms.
    """
    inside = F.coalesce("inside", ~F.col("term").rlike(f"^{WORD_TERM}$"))
    terms = dictionary.where("term <> ''").select("topic", F.lower("term").alias("term"), inside.alias("inside"), F.lit(False).alias("beside"))
    beside = dictionary.where("context <> ''").select("topic", F.lower("context").alias("term"), (~F.col("context").rlike(f"^{WORD_TERM}$")).alias("inside"), F.lit(True).alias("beside"))
    known = terms.unionByName(beside).distinct()
    size = known.agg(F.min(F.length("term")).alias("least"), F.max(F.length("term")).alias("most"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    small = size["n"] <= MOST_BROADCAST and (size["bytes"] or 0) <= MOST_TERM_BYTES
    sent = F.broadcast if small else lambda df: df
    found = known_places(docs, known, id_column, text) if small else joined_places(docs, known, id_column, text, size["least"], size["most"])
    found = found.distinct().groupBy(id_column, "topic").agg(F.count_if(~F.col("beside")).alias("terms"), F.bool_or("beside").alias("beside"))
    bound = dictionary.where("context <> ''").select("topic").distinct().withColumn("bound", F.lit(True))
    explicit = found.join(sent(bound), "topic", "left").where((F.col("terms") > 0) & (F.col("bound").isNull() | F.col("beside"))).select(id_column, "topic", "terms")
    # Each topic is its own ancestor here, so that what is found is gone through once.
    above = ancestors(dictionary.select("topic", "parent")).unionByName(dictionary.select("topic", F.col("topic").alias("ancestor")).distinct()).withColumnRenamed("topic", "below")
    own = F.col("topic").eqNullSafe(F.col("ancestor"))
    every = explicit.join(sent(above), F.col("topic").eqNullSafe(F.col("below"))).select(id_column, F.col("ancestor").alias("topic"), F.when(own, "explicit").otherwise("implied").alias("how"), F.when(own, F.col("terms")).otherwise(0).alias("terms"))
    return every.groupBy(id_column, "topic").agg(F.min("how").alias("how"), F.max("terms").alias("terms"))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))
