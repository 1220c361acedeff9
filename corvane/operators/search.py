"""Text search over asset texts and symbol search with ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import breadcrumb, initials, literal_pattern, typo_distance

#: Kinds of assets that are searched only with all_assets.
MEDIA_KINDS = ["texture", "mesh", "sound", "animation"]
#: Queries of a table that are sent to all tasks at once; more of them go in several blocks.
BLOCK = 10_000
#: Queries of a table up to which each text is simply asked for all of them in one pass.
FEW = 64


def scope_texts(texts: DataFrame, names: bool = False, all_assets: bool = False, editor_caches: bool = False, media_kinds: list[str] = MEDIA_KINDS) -> DataFrame:
    """The texts that a search covers; plain filters, so they reach the scan."""
    if not names:
        texts = texts.where(~F.col("is_name"))
    if not all_assets:
        texts = texts.where(~F.col("asset_kind").isin(media_kinds))
    if not editor_caches:
        texts = texts.where(~F.col("is_editor_cache"))
    return texts


def matches(text: str, query: Column, match_case: bool = False, whole_word: bool = False) -> Column:
    """Whether the text holds the query as a substring, or as whole words; without case unless match_case."""
    t, q = (F.col(text), query) if match_case else (F.lower(F.col(text)), F.lower(query))
    return F.regexp_like(t, F.concat(F.lit(r"(?<!\w)"), literal_pattern(q), F.lit(r"(?!\w)"))) if whole_word else F.contains(t, q)


def _grams(text: Column, n: int) -> Column:
    """The different runs of n characters of a text: its characters beside those that follow, so a long text takes no longer a character than a short one."""
    letters = F.split(text, "")
    runs = letters
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(letters, k + 1, 1 << 30), lambda x, y: F.concat(x, y))
    return F.array_compact(F.array_distinct(runs))


def _gram_of(query: Column) -> Column:
    """A run of characters that every text with the query has: its first three, or all of a shorter one."""
    return F.substring(query, 1, 3)


def _in_blocks(rows: DataFrame, queries: DataFrame, on: str) -> DataFrame:
    """rows joined with a stated set of queries by an equality key, BLOCK queries at a time, so what is broadcast is bounded."""
    blocks = -(-queries.count() // BLOCK) or 1
    part = lambda i: queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id", on), F.lit(blocks)) == i)
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(part(i)), on) for i in range(blocks)])


def search_text(texts: DataFrame, query: str | DataFrame, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Texts that hold the query (two characters at least), with breadcrumb text if there is one.

    One query is a filter on the scan, and a table (query_id, query) of up to FEW is one pass over the texts. A query of a larger table meets only texts that have its first three
    characters (an equality join with the texts' 3-grams), and these are then checked in full.
    """
    where = [c for c in ("breadcrumb",) if c in texts.columns]
    shown = texts.withColumn("place", breadcrumb("breadcrumb")) if where else texts
    if isinstance(query, str):
        if len(query) < 2:
            raise ValueError("a query takes two characters at least")
        return shown.where(matches("text", F.lit(query), match_case, whole_word))
    asked = query.where(F.length("query") >= 2)
    few = asked.limit(FEW + 1).collect()
    if len(few) <= FEW:
        told = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in asked.schema]) for r in few]) if few else F.lit(None).cast(T.ArrayType(asked.schema))
        hit = lambda q: matches("text", q["query"], match_case, whole_word)
        return shown.withColumn("_asked", F.explode(F.filter(told, hit))).select(*shown.columns, "_asked.*")
    fold = (lambda c: c) if match_case else F.lower
    asked = asked.withColumn("_gram", _gram_of(fold(F.col("query"))))
    text = fold(F.col("text"))
    held = shown.withColumn("_gram", F.explode(F.concat(_grams(text, 2), _grams(text, 3))))
    return _in_blocks(held, asked, "_gram").where(matches("text", F.col("query"), match_case, whole_word)).drop("_gram")


def symbol_filter(symbols: DataFrame, kinds: list[str] | None = None, container: str | None = None) -> DataFrame:
    """Symbols of some kinds and, if given, of one container (as `AFoo::Bar` and `Tick::` ask for)."""
    if kinds is not None:
        symbols = symbols.where(F.col("kind").isin(kinds))
    return symbols.where(F.col("container") == container) if container is not None else symbols


def container_query(text: str) -> tuple[str | None, str]:
    """A query's container and name: `AFoo::Bar` asks for Bar inside AFoo, `Tick::` for all inside Tick, `Bar` for Bar anywhere."""
    container, sep, name = text.rpartition("::")
    return (container or None if sep else None), name


def scoped_symbols(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols that a query with an optional container finds: the name as a substring, without case."""
    container, name = container_query(text)
    found = symbol_filter(symbols, container=container)
    return found.where(F.contains(F.lower("name"), F.lit(name.lower()))) if name else found


def scope_filter(df: DataFrame, include_engine: bool, scope: str = "scope") -> DataFrame:
    return df if include_engine else df.where(F.col(scope) != "engine")


def word_rank(name: str, word: Column, fuzzy: bool = True) -> Column:
    """How a word meets a name: 0 same, 1 start, 2 initials, 3 inside, 4 as a subsequence, 5 with a typo; null if not at all."""
    n, w = F.lower(F.col(name)), F.lower(word)
    rank = F.when(n == w, 0).when(F.startswith(n, w), 1)
    if not fuzzy:
        return rank.when(F.contains(n, w), 3)
    letters = F.array_join(F.transform(F.split(w, ""), literal_pattern), ".*")
    most = F.when(F.length(word) <= 8, typo_distance("")).otherwise(typo_distance("x" * 9))
    near = F.exists(F.split(n, r"[^a-z0-9]+"), lambda x: F.levenshtein(x, w) <= most)
    return rank.when(F.startswith(initials(name), word), 2).when(F.contains(n, w), 3).when(F.regexp_like(n, letters), 4).when(near, 5)


def _segments(word: Column) -> Column:
    """What a word within the typo distance d has: of the d + 1 parts of nearly equal length that `word` is cut into, one at least is whole in it, and so are that part's first
    three characters."""
    n = F.length(word)

    def part(parts: int) -> Column:
        at = [F.floor(n * i / parts).cast("int") for i in range(parts + 1)]
        return F.array(*[F.substring(word, x + 1, F.least(y - x, F.lit(3))) for x, y in zip(at[:-1], at[1:], strict=True)])

    return F.when(n <= 8, part(typo_distance("") + 1)).otherwise(part(typo_distance("x" * 9) + 1))


def _pairs(letters: Column) -> Column:
    """All pairs of different places' letters in order, each once: per different letter, the different letters behind its first place. So a long name has no more pairs than its alphabet allows."""
    return F.flatten(F.transform(F.array_distinct(letters), lambda x: F.transform(F.array_distinct(F.slice(letters, F.array_position(letters, x).cast("int") + 1, F.size(letters))), lambda y: F.concat(x, y))))


def _tagged(tag: str, keys: Column) -> Column:
    return F.transform(keys, lambda x: F.concat(F.lit(tag), x))


def _name_keys(name: str, fuzzy: bool) -> Column:
    """What a name can be found by: runs of up to three characters, beginnings of its initials, pairs of letters in order, and whether it has a word of two letters at most. The keys grow in proportion to the name."""
    n = F.lower(F.col(name))
    keys = [_tagged("g", _grams(n, k)) for k in (1, 2, 3)]
    if fuzzy:
        own, letters = initials(name), F.split(n, "")
        words = F.split(n, r"[^a-z0-9]+")
        keys += [
            _tagged("i", F.when(F.length(own) > 0, F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: F.substring(own, F.lit(1), i))).otherwise(F.array().cast("array<string>"))),
            _tagged("s", _pairs(letters)),
            F.when(F.exists(words, lambda x: F.length(x) <= 2), F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")),
        ]
    return F.array_distinct(F.concat(*keys))


def _word_keys(word: str, fuzzy: bool) -> Column:
    """The keys of a word: a name that it meets by some rule has one of them."""
    w = F.lower(F.col(word))
    keys = [F.array(F.concat(F.lit("g"), _gram_of(w)))]
    if fuzzy:
        keys += [F.array(F.concat(F.lit("i"), word)), F.array(F.concat(F.lit("s"), F.substring(w, 1, 1), F.right(w, F.lit(1)))), F.when(F.length(w) <= 1, F.array(F.lit("t"))).otherwise(_tagged("g", _segments(w)))]
    return F.array_distinct(F.concat(*keys))


def search_symbols(symbols: DataFrame, queries: DataFrame, k: int = 20, fuzzy: bool = True) -> DataFrame:
    """(query_id, rank, symbol_id, name, n_words): the k best symbols for each query (query_id, query): any word is enough, symbols with more words come
    first, then better ranks, shorter names, names, ids. Words meet names by equality keys (3-grams, initials, pairs of letters, segments that a typo leaves whole), and
    each pair that meets is then ranked in full; the top k is cut in each task before the shuffle."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split("query", r"\s+"), lambda w: w != ""))).alias("word"))
    keyed = words.withColumn("_key", F.explode(_word_keys("word", fuzzy)))
    named = symbols.select("symbol_id", "name").withColumn("_key", F.explode(_name_keys("name", fuzzy)))
    hits = _in_blocks(named, keyed, "_key").select("query_id", "word", "symbol_id", "name").distinct()
    hits = hits.withColumn("_rank", word_rank("name", F.col("word"), fuzzy)).where("_rank is not null").groupBy("query_id", "symbol_id", "name").agg(F.count("*").alias("n_words"), F.sum("_rank").alias("_rank"))
    best = Window.partitionBy("query_id").orderBy(F.desc("n_words"), "_rank", F.length("name"), "name", "symbol_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "symbol_id", "name", "n_words")
