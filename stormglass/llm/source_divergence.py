"""Operator 12: source divergence audit, by a vocabulary automaton in two passes.

The first pass counts exactly in how many documents of a language each term occurs; terms in
LEAST_DOCS of them are kept.  The second recounts occurrences of kept terms with Aho-Corasick automata
over the texts, terms and texts padded by one delimiter on each side, so that only whole terms match.  The most
frequent terms, MOST_TERMS at most, are one broadcast and are counted where a text is read.  What no
match covers there, a small part of a text, goes on as padded blocks to shards of the other kept terms,
each with an automaton of its own; a shard with much text is dealt to several tasks.  So no automaton grows with
the vocabulary, and texts are read twice however large it is.

Counts by (language, source, term) are sparse: absent terms have no row.  A source gives each kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), N its occurrences of kept terms, V their number; so does the language as a
whole.  The divergence of p from q at a term is floor((p - q)**2 / q).  Summed over all kept
terms it ranks the pairs of sources of a language; of each source against its language it ranks the terms.  A pair's sum is that of
two sources that have no term, plus what each one's own terms change (by the number of terms with one value
of p), plus what shared terms change (from the postings of each term): absent terms cost nothing.

Cases: null text, lang and source are empty ones; sources without a kept term have rows in part ``pair``
and none in ``term``; a language without a kept term gives 0 for all its pairs, one with one source has no pair; ties go to the smaller item by bytes;
repeated rows are documents of their own; long texts are read by pieces cut at delimiters; an empty table gives an empty
one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_of, cut, documents, slices

#: A kept term's documents; terms of a source that part ``term`` lists; what p is a share of.
LEAST_DOCS, TOP, SCALE = 3, 200, 10**9
#: The broadcast automaton: terms, and bytes of a term or a language (12.8 MB of terms at most).
MOST_TERMS, LONGEST = 200_000, 64
#: Terms of a shard, and bytes of text that one automaton of it reads.
SHARD_TERMS, SHARD_BYTES = 50_000, 2**24
#: Counters, matches, and tokens for the shards, that a task holds.
HELD_TERMS, HELD_MATCHES, HELD_TOKENS = 400_000, 6_000_000, 400_000
#: Sources up to which sums of pairs are a table and not a dictionary.
TABLE_SOURCES = 1024
#: Bytes of text that a task cuts into tokens at once.
PIECE = 2**22
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a term stay, A-Z lower-cased; all other ASCII is a delimiter.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: str) -> Iterator[bytes]:
    """A text in letters and blanks, PIECE bytes or some more at a time."""
    body = text.encode("utf-8")
    at = 0
    while at < len(body):
        part = body[at : at + PIECE].translate(_LETTERS)
        at += len(part)
        while part[-1:] != b" " and at < len(body):  # on to the next delimiter
            more = body[at : at + 4096].translate(_LETTERS)
            end = more.find(b" ")
            more = more if end < 0 else more[: end + 1]
            part += more
            at += len(more)
        yield part


def _rows(df: DataFrame, text_col: str, group_col: str, source_col: str) -> DataFrame:
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((group_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_frequencies(rows: DataFrame) -> DataFrame:
    """lang, term and n_docs of every term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), _strings(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "term", "n"])
            found.clear()

        for langs, texts in slices(batches):
            for lang, text in zip(langs, texts, strict=True):
                found[lang].update(set().union(*(part.split() for part in pieces(text))))
            if sum(map(len, found.values())) > HELD_TERMS:
                yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(count, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n_docs"))


def automaton(terms: Iterable[tuple[int, str]]) -> ahocorasick.Automaton | None:
    """Finds each term between two delimiters and says its number; None without terms."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in terms:
        out.add_word(f" {term} ", number)
    if not len(out):
        return None
    out.make_automaton()
    return out


#: The automata of the last broadcast that this worker has used, by language.
_BUILT: dict[tuple[str, str], ahocorasick.Automaton | None] = {}


def _built(key: str, lang: str, terms: dict[str, list[tuple[int, str]]]) -> ahocorasick.Automaton | None:
    if (key, lang) not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key]:
            del _BUILT[old]
        _BUILT[key, lang] = automaton(terms.get(lang, ()))
    return _BUILT[key, lang]


def scan(finder: ahocorasick.Automaton | None, part: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of the terms found, each as often as it occurs, and the tokens that are none of them."""
    tokens = part.split()  # by blanks: other delimiters are blanks already, and no byte of a letter is one
    if finder is None or not tokens:
        return np.zeros(0, np.int32), tokens
    line = f" {b' '.join(tokens).decode('utf-8')} "
    matches = np.fromiter(chain.from_iterable(finder.iter(line)), np.int64)
    ends, found = matches[0::2], matches[1::2].astype(np.int32)
    if len(found) == len(tokens):
        return found, []
    blanks = np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32
    blanks[0] = False
    after = np.cumsum(blanks)  # at a token's end: how many have ended
    left = np.ones(len(tokens), bool)
    left[after[ends] - 1] = False
    return found, [tokens[i] for i in np.flatnonzero(left)]


def _count_frequent(rows: DataFrame, frequent: Broadcast, n_shards: int) -> DataFrame:
    """source, term_no and n of a source's frequent terms; lang, source, shard and block of its other tokens (none without shards)."""
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"lang": pa.string(), "source": pa.string(), "term_no": pa.int32(), "n": pa.int64(), "shard": pa.int32(), "block": pa.string()}
        matches: dict[str, list[np.ndarray]] = defaultdict(list)
        rest: dict[tuple[str, str], list[bytes]] = defaultdict(list)

        def batch_with(n_rows: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n_rows, kind) for c, kind in kinds.items()], names=list(kinds))

        def flush_counts() -> Iterator[pa.RecordBatch]:
            for source, found in matches.items():
                numbers, n = np.unique(np.concatenate(found), return_counts=True)
                yield batch_with(len(n), source=pa.repeat(source, len(n)), term_no=pa.array(numbers), n=pa.array(n.astype(np.int64)))
            matches.clear()

        def flush_rest() -> Iterator[pa.RecordBatch]:
            for (lang, source), tokens in rest.items():
                dealt = defaultdict(list)
                for t in tokens:
                    dealt[zlib.crc32(t) % n_shards].append(t)
                n = len(dealt)
                blocks = _strings([b" %b " % b" ".join(x) for x in dealt.values()])
                yield batch_with(n, lang=pa.repeat(lang, n), source=pa.repeat(source, n), shard=pa.array(list(dealt), pa.int32()), block=blocks)
            rest.clear()

        held = n_matches = 0
        for some in slices(batches):
            for lang, source, text in zip(*some, strict=True):
                finder = _built(key, lang, frequent.value)
                for part in pieces(text):
                    found, left = scan(finder, part)
                    if len(found):
                        matches[source].append(found)
                        n_matches += len(found)
                    if n_matches > HELD_MATCHES:
                        yield from flush_counts()
                        n_matches = 0
                    if left and n_shards:
                        rest[lang, source] += left
                        held += len(left)
                    if held > HELD_TOKENS:
                        yield from flush_rest()
                        held = 0
        yield from flush_counts()
        yield from flush_rest()

    return rows.mapInArrow(count, "lang string, source string, term_no int, n long, shard int, block string")


def _count_rest(kept: DataFrame, blocks: DataFrame) -> DataFrame:
    """lang, source, term and n: blocks (lang, source, shard, block) read by the automata of the terms (lang, shard, term) of their shards."""
    sizes = cut(blocks.groupBy("lang", "shard").agg(F.ceil(F.sum(F.octet_length("block").cast("long")) / SHARD_BYTES).alias("parts")))
    no = F.lit(None).cast("string")
    terms = kept.join(sizes, ["lang", "shard"]).select("lang", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "term", no.alias("source"), no.alias("block"))
    texts = blocks.join(sizes, ["lang", "shard"]).select("lang", "shard", F.pmod(F.xxhash64("source", "block"), "parts").alias("part"), no.alias("term"), "source", "block")
    # Nulls sort first: the terms of a part come before its blocks.
    dealt = terms.unionByName(texts).repartition("lang", "shard", "part").sortWithinPartitions("lang", "shard", "part", "block", "term")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64())])
        counts: dict[str, Counter] = defaultdict(Counter)
        at, names, finder = None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            for source, c in counts.items():
                yield batch_of(schema, [[at[0]] * len(c), [source] * len(c), [names[i] for i in c], list(c.values())])
            counts.clear()

        for some in slices(batches):
            for lang, shard, part, term, source, block in zip(*some, strict=True):
                if (lang, shard, part) != at:
                    yield from flush()
                    at, names, finder = (lang, shard, part), [], None
                if block is None:
                    names.append(term)
                elif names:
                    finder = finder or automaton(enumerate(names))
                    counts[source].update(v for _, v in finder.iter(block))
                    if sum(map(len, counts.values())) > HELD_TERMS:
                        yield from flush()
        yield from flush()

    return dealt.mapInArrow(count, "lang string, source string, term string, n long")


def postings(rows: DataFrame, kept: DataFrame, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, term and n > 0: how often a source of a language has a kept term.  ``kept`` has lang, term and n_docs."""
    band = F.floor(F.log2("n_docs") * 8)
    ranked = kept.withColumn("band", band).withColumn("fits", (F.octet_length("term") <= LONGEST) & (F.octet_length("lang") <= LONGEST))
    least, n = None, 0
    for r in sorted(ranked.filter("fits").groupBy("band").count().collect(), reverse=True):  # some hundred rows
        n += r["count"]
        if n > most_terms:
            break
        least = r["band"]
    chosen = F.col("fits") & (F.col("band") >= least) if least is not None else F.lit(False)
    frequent = defaultdict(list)
    for number, r in enumerate(listed := ranked.filter(chosen).select("lang", "term").collect()):
        frequent[r["lang"]].append((number, r["term"]))
    numbers = rows.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(listed)], "term_no int, lang string, term string")
    others = ranked.filter(~chosen)
    n_shards = -(-others.count() // SHARD_TERMS)
    found = cut(_count_frequent(rows, rows.sparkSession.sparkContext.broadcast(dict(frequent)), n_shards))
    counts = found.filter("term_no is not null").groupBy("source", "term_no").agg(F.sum("n").alias("n")).join(numbers, "term_no").select("lang", "source", "term", "n")
    if n_shards:
        shard = (F.crc32("term") % n_shards).cast("int").alias("shard")
        rest = _count_rest(others.select("lang", shard, "term"), found.filter("block is not null").select("lang", "source", "shard", "block"))
        counts = counts.unionByName(rest.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")))
    return counts


def _div(a: Column, b: Column) -> Column:
    """The quotient of two whole numbers that are not negative, rounded down."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """p of a term with ``n`` occurrences where ``total`` is N + V."""
    whole = lambda c: c.cast("decimal(19,0)")
    return 1 + _div(F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(total))


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _shared_terms(found: DataFrame) -> DataFrame:
    """lang, source, item and value: what the terms that two sources share change in their sum.  ``found`` has lang, source, term, p and zero."""
    dealt = found.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        sums: dict[tuple[int, int], int] = {}
        table_of = np.zeros((0, 0), np.int64)
        names, numbers = [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, j in zip(*np.nonzero(table_of), strict=True):
                sums[int(i), int(j)] = sums.get((int(i), int(j)), 0) + int(table_of[i, j])
            table_of[:] = 0
            if sums:
                a, b = zip(*sums, strict=True)
                yield batch_of(schema, [[names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b], list(sums.values())])
            sums.clear()

        def numbered(table: pa.Table) -> np.ndarray:
            """The number of each row's source of a language."""
            lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            width = len(source.dictionary)
            codes, inverse = np.unique(lang.indices.to_numpy() * np.int64(width) + source.indices.to_numpy(), return_inverse=True)
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            own = []
            for code in codes.tolist():
                name = (langs[code // width], sources[code % width])
                if name not in numbers:
                    numbers[name] = len(names)
                    names.append(name)
                own.append(numbers[name])
            return np.array(own, np.int64)[inverse]

        def add(table: pa.Table, starts: np.ndarray) -> None:
            """The postings of a term lie side by side; ``starts`` are the first ones.  Each posting meets the one k places further on, k growing."""
            nonlocal table_of
            who, p, zero = numbered(table), table["p"].to_numpy(), table["zero"].to_numpy()
            f = lambda x, y: (x - y) * (x - y) // y
            if len(names) <= TABLE_SOURCES and len(table_of) < len(names):
                room = len(names) - len(table_of)
                table_of = np.pad(table_of, ((0, room), (0, room)))
            sizes = np.diff(np.append(starts, len(who)))
            ends = np.repeat(starts + sizes, sizes)
            i, k = np.arange(len(who)), 1
            while len(i := i[i + k < ends[i]]):
                for a, b in ((i, i + k), (i + k, i)):
                    more = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
                    if len(names) <= TABLE_SOURCES:
                        np.add.at(table_of, (who[a], who[b]), more)
                        continue
                    key, inverse = np.unique(who[a] << 32 | who[b], return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, inverse, more)
                    for x, v in zip(key.tolist(), total.tolist(), strict=True):
                        pair = (x >> 32, x & 0xFFFFFFFF)
                        sums[pair] = sums.get(pair, 0) + v
                k += 1

        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            n = table.num_rows
            other = [pc.not_equal(table[c].slice(1), table[c].slice(0, n - 1)).to_numpy() for c in ("lang", "term")] if n > 1 else [np.zeros(0, bool)] * 2
            starts = np.append(0, np.flatnonzero(other[0] | other[1]) + 1)
            if len(starts) > 1:  # the last term may go on in the next batch
                add(table.slice(0, int(starts[-1])), starts[:-1])
                table = table.slice(int(starts[-1]))
            tail = table.combine_chunks().to_batches()[0] if table.num_rows else tail
            if len(sums) > HELD_TERMS:
                yield from flush()
        if tail is not None:
            add(pa.Table.from_batches([tail]), np.zeros(1, np.int64))
        yield from flush()

    return dealt.mapInArrow(pairs, "lang string, source string, item string, value long")


def divergences(df: DataFrame, text_col: str = "text", group_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of every pair of sources and of the ``top`` terms of each source."""
    rows = _rows(df, text_col, group_col, source_col)
    kept = cut(document_frequencies(rows).filter(F.col("n_docs") >= least_docs))
    counts = cut(postings(rows, kept, most_terms))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    named = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n_found")), ["lang", "source"], "left").join(sizes, "lang", "left")
    total = F.coalesce("n_found", F.lit(0)) + F.col("n_terms")
    groups = cut(named.select("lang", "source", "n_terms", total.alias("total"), share(F.lit(0).cast("long"), total).alias("zero")))
    of_lang = cut(groups.groupBy("lang").agg((F.sum(F.col("total") - F.col("n_terms")) + F.first("n_terms")).alias("lang_total")))
    found = cut(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "zero", share(F.col("n"), F.col("total")).alias("p"), "n"))

    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(of_lang, "lang").select("lang", "term", share(F.col("n"), F.col("lang_total")).alias("q"))
    p, q = F.col("p"), F.col("q")
    above = found.join(whole, ["lang", "term"]).filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(p, q).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    both = groups.join(other, "lang").filter("source <> item")
    z, o = F.col("zero"), F.col("other_zero")
    exact = lambda c: c.cast("decimal(38,0)")
    none = both.select("lang", "source", "item", exact(F.coalesce(F.col("n_terms") * divergence(z, o), F.lit(0))).alias("value"))
    alike = found.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("n")).join(other, "lang").filter("source <> item")
    alike = alike.groupBy("lang", "source", "item").agg(
        F.sum(exact(F.col("n")) * exact(divergence(p, o) - divergence(z, o))).alias("own"),
        F.sum(exact(F.col("n")) * exact(divergence(o, p) - divergence(o, z))).alias("others"),
    )
    own = alike.select("lang", "source", "item", exact(F.col("own")).alias("value"))
    others = alike.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), exact(F.col("others")).alias("value"))
    shared = _shared_terms(found).withColumn("value", exact(F.col("value")))
    summed = none.unionByName(own).unionByName(others).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(ranked)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


#: Every group has every kept term here, absent ones too; sums in 128 bits.
ORACLE_SQL = {
    "op12_source_divergence": f"""
    WITH d AS (
        SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
    t AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
    lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
    p AS (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v)::HUGEINT AS p
        FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
    q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (lc.n + 1)) // (ln.n + v.v)::HUGEINT AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
    s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
    QUALIFY part = 'pair' OR rank <= {TOP}
    """
}
QUERIES = {"op12_source_divergence": op12_source_divergence}
