"""From source records to documents: projection, text building, quality reasons, deduplication.

"Absent" is null, ``''``, 0 or an empty array throughout. Empty tables give empty tables. Operators name the columns they
read, so further columns change nothing.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import first_present, present, year_of
from tessera.skew import hot_keys, salted_lookup

MAX_CAST, LEGACY_CAST = 10, 5
MIN_REVIEW_CHARS = 30


def list_projection(listing: DataFrame) -> DataFrame:
    """Ten fields of a listing item with defaults for what is absent."""
    text, number = F.lit(""), F.lit(0)
    return listing.select(
        "tmdb_id",
        F.coalesce("title", text).alias("title"),
        year_of(F.col("year")).alias("year"),
        F.coalesce("overview", text).alias("overview"),
        F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"),
        F.coalesce("vote_count", number).cast("bigint").alias("vote_count"),
        F.coalesce("original_language", F.lit("en")).alias("original_language"),
        F.coalesce("genre_ids", F.array().cast("array<bigint>")).alias("genre_ids"),
        F.coalesce("popularity", F.lit(0.0)).alias("popularity"),
        F.coalesce("poster_path", text).alias("poster_path"),
    )


def director_names(crew: Column) -> Column:
    """Names of the crew whose job is Director, joined with ``', '``; ``''`` without any."""
    kept = F.filter(F.coalesce(crew, F.array()), lambda c: c["job"] == "Director")
    return F.array_join(F.transform(kept, lambda c: c["name"]), ", ")


def detail_projection(details: DataFrame, url_prefix: str = "https://films.example/title/", keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat fields of a detail record: directors joined, the first ten cast names, genre names, one imdb id, year, URL.

    Columns named in ``keep`` are passed on as they are.
    """
    names = lambda a: F.transform(F.coalesce(a, F.array()), lambda x: x["name"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return details.select(
        *keep,
        "tmdb_id",
        blank("title").alias("title"),
        blank("original_title").alias("original_title"),
        year_of(F.col("release_date")).alias("year"),
        blank("overview").alias("overview"),
        blank("tagline").alias("tagline"),
        blank("status").alias("status"),
        blank("poster_path").alias("poster_path"),
        F.coalesce("original_language", F.lit("en")).alias("original_language"),
        zero("budget"),
        zero("revenue"),
        zero("runtime"),
        zero("vote_count"),
        F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"),
        director_names(F.col("credits.crew")).alias("director"),
        names(F.slice(F.coalesce(F.col("credits.cast"), F.array()), 1, MAX_CAST)).alias("cast"),
        names(F.col("genres")).alias("genres"),
        F.coalesce(present("external_ids.imdb_id"), F.col("imdb_id"), F.lit("")).alias("imdb_id"),
        F.concat(F.lit(url_prefix), F.col("tmdb_id").cast("string")).alias("source_url"),
    )


def rich_text(title: Column, tagline: Column, genres: Column, director: Column, cast: Column, overview: Column, reviews: Column) -> Column:
    """Title twice, tagline, genres, director, at most ten cast names, overview, reviews of at least 30 characters.

    Absent parts are skipped; single spaces between parts.
    """
    joined = lambda a: present(F.array_join(F.coalesce(a, F.array()), " "))
    long_reviews = F.filter(F.coalesce(reviews, F.array()), lambda r: F.length(r) >= MIN_REVIEW_CHARS)
    people = F.slice(F.coalesce(cast, F.array()), 1, MAX_CAST)
    return F.concat_ws(" ", present(title), present(title), present(tagline), joined(genres), present(director), joined(people), present(overview), joined(long_reviews))


def enriched_text(current: Column, reviews: Column) -> Column:
    """The text followed by the reviews that are not empty, trimmed."""
    kept = F.filter(F.coalesce(reviews, F.array()), lambda r: r != "")
    return F.trim(F.concat_ws(" ", current, F.array_join(kept, " ")))


def build_documents(details: DataFrame, reviews: DataFrame) -> DataFrame:
    """Nested documents (title, year, metadata, rich_text, reviews_count) from flat details and tmdb_id, reviews.

    ``reviews_count`` counts all reviews, those too short for the text included.
    """
    r = reviews.select("tmdb_id", F.col("reviews").alias("__reviews"))
    d = details.join(r, "tmdb_id", "left")
    meta = ("director", "cast", "genres", "budget", "revenue", "vote_average", "vote_count", "original_language", "imdb_id", "tmdb_id", "source_url", "tagline", "runtime", "original_title")
    text = rich_text(F.col("title"), F.col("tagline"), F.col("genres"), F.col("director"), F.col("cast"), F.col("overview"), F.col("__reviews"))
    return d.select("title", "year", F.struct(*meta).alias("metadata"), text.alias("rich_text"), F.coalesce(F.size("__reviews"), F.lit(0)).cast("bigint").alias("reviews_count"))


def _joined(*parts: Column, reviews: Column) -> Column:
    return F.concat_ws(" ", *[present(x) for x in parts], present(F.array_join(F.filter(F.coalesce(reviews, F.array()), lambda r: r != ""), " ")))


def legacy_text(title: Column, year: Column, synopsis: Column, director: Column, genre: Column, awards: Column, cast: Column, reviews: Column, metadata: Column | None = None) -> Column:
    """Text of a flat legacy record for indexing: seven root fields, then what its ``metadata`` has of director, genres, the first
    five of the cast and tagline, then the reviews; absent parts are skipped."""
    more = []
    if metadata is not None:
        many = lambda a: F.array_join(F.coalesce(a, F.array()), " ")
        more = [metadata["director"], many(metadata["genres"]), many(F.slice(F.coalesce(metadata["cast"], F.array()), 1, LEGACY_CAST)), metadata["tagline"]]
    return _joined(title, year, synopsis, director, genre, awards, cast, *more, reviews=reviews)


def legacy_reading_text(title: Column, synopsis: Column, director: Column, genre: Column, reviews: Column) -> Column:
    """Text of a flat legacy record for reading: four root fields and the reviews, absent parts skipped."""
    return _joined(title, synopsis, director, genre, reviews=reviews)


def text_for_index(rich: Column, legacy: Column) -> Column:
    """The rich text, or the legacy text where it is absent (null or empty)."""
    return first_present(rich, legacy)


def text_for_reading(rich: Column, legacy: Column) -> Column:
    """The rich text wherever the record has that field at all, even empty; else the legacy text."""
    return F.coalesce(rich, legacy)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, by partial aggregation: a hot key sends one row a task, not all its rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def dedup_first_wins(docs: DataFrame, order: Column, key1: Column, key2: Column) -> DataFrame:
    """Rows kept when rows arrive in ``order`` and a row with a known key is skipped.

    The key is ``key1`` (an id) where it is present, else ``key2`` (a URL); rows with neither all stay. First the first row
    of each id, then the first of each URL among all the rest. This equals row-by-row insertion whenever the URL is a
    function of the id; otherwise it may keep one row less where a row skipped for its URL would have been the first of its id.
    """
    d = docs.select("*", order.alias("__o"), key1.alias("__k1"), key2.alias("__k2"))
    columns = docs.columns
    with_id = first_by(d.where(F.col("__k1").isNotNull()), ["__k1"], [F.col("__o")])
    survivors = with_id.select(*d.columns).unionByName(d.where(F.col("__k1").isNull()))
    keyed = first_by(survivors.where(F.col("__k2").isNotNull()), ["__k2"], [F.col("__o")])
    free = survivors.where(F.col("__k2").isNull())
    return keyed.select(*columns).unionByName(free.select(*columns))


def strategy_union(first: DataFrame, second: DataFrame, key: str, name_first: str, name_second: str) -> DataFrame:
    """key, strategy: every key of the first strategy, then those of the second not seen in the first."""
    a = first.select(key, F.lit(0).alias("rank"))
    b = second.select(key, F.lit(1).alias("rank"))
    best = a.unionByName(b).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("rank").alias("rank"))
    return best.select(key, F.when(F.col("rank") == 0, F.lit(name_first)).otherwise(F.lit(name_second)).alias("strategy"))


def outcome_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds, else ``kept``. A null test does not hold."""
    reason = F.lit("kept")
    for name, test in reversed(tests):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return reason


def enrich_outcomes(candidates: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """One row enriched, skipped, errors: candidates that got reviews, got none, or were never fetched (counted as skipped, too).

    ``fetched`` has one row a key with ``reviews``; null means that fetching failed.
    """
    j = candidates.select(key).join(fetched.select(key, "reviews"), key, "left")
    got = F.coalesce(F.size("reviews"), F.lit(-1))
    return j.agg(F.count_if(got > 0).alias("enriched"), F.count_if(got <= 0).alias("skipped"), F.count_if(F.col("reviews").isNull()).alias("errors"))


def source_filters(listing: DataFrame, strategies: dict[str, int], min_year: int = 1990, language: str = "en", adult: str | None = None) -> DataFrame:
    """Rows of each strategy with at least its number of votes, released from ``min_year`` on, in ``language``; with a column named
    in ``adult`` only rows for which it is not true.

    All of it is comparisons of columns, so a Parquet scan sees them as pushed filters. Rows with an absent value are left out;
    an absent adult flag counts as false.
    """
    if adult is not None:
        listing = listing.where(F.col(adult).isNull() | ~F.col(adult))
    enough = F.lit(False)
    for name, votes in strategies.items():
        enough |= (F.col("strategy") == name) & (F.col("vote_count") >= votes)
    return listing.where(enough & (F.col("year") >= str(min_year)) & (F.col("original_language") == language))


def listing_page(listing: DataFrame, strategy: str, sort: str, page: int = 1, size: int = 20, key: str = "tmdb_id") -> DataFrame:
    """key and ``sort`` of one page of a strategy's items, highest first, ties by key; an item listed several times counts once."""
    items = listing.where(F.col("strategy") == strategy).groupBy(key).agg(F.max(sort).alias(sort))
    return items.orderBy(F.desc_nulls_last(sort), key).offset((page - 1) * size).limit(size)


def enrich_candidates(docs: DataFrame, done: DataFrame, limit: int = 0) -> DataFrame:
    """doc_id of the documents with an imdb id and no reviews that are not in ``done`` (doc_id); the first ``limit`` by id, or all for 0."""
    open_ = docs.where(present("metadata.imdb_id").isNotNull() & (F.col("reviews_count") == 0)).select("doc_id")
    left = unprocessed(open_, done, "doc_id")
    return left.orderBy("doc_id").limit(limit) if limit > 0 else left


def unprocessed(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``seen``; rows without a key stay."""
    return rows.join(seen.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def first_match(rows: DataFrame, key: str, candidates: list[Column], table: DataFrame, on: str, value: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """key, value: of several candidate keys in priority order, the value of the first that the table has and that is not absent.

    ``table`` has one row per ``on``. Rows without a match have a null value. A candidate that very many rows share is looked up
    in several tasks.
    """
    tried = rows.select(F.col(key), F.posexplode(F.array(*candidates)).alias("priority", on))
    hot = hot_keys(tried.groupBy(on).agg(F.count(F.lit(1)).alias("n")), on, F.col("n"), rows_per_task)
    found = salted_lookup(tried, table.select(on, value).where(present(value).isNotNull()), on, hot, F.col(key))
    best = found.groupBy(key).agg(F.min_by(value, "priority").alias(value))
    return rows.select(key).distinct().join(best, key, "left")


def dense_ids(df: DataFrame, order: list[str], name: str = "doc_id") -> DataFrame:
    """Ids 0, 1, 2 ... by ``order``, without a window over one partition.

    Rows are range-partitioned by ``order`` and written to the checkpoint folder, then each partition's start is the count
    of those before it (one number a partition is collected).
    """
    from tessera.lineage import cut

    parts = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    fixed = cut(parts.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id() % F.lit(1 << 33)))
    counts = sorted((r["__part"], r["n"]) for r in fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(part, start) for (part, _), start in zip(counts, starts)], "__part int, __start bigint")
    placed = fixed.join(F.broadcast(offsets), "__part")  # one row a partition
    return placed.withColumn(name, F.col("__start") + F.col("__n")).drop("__part", "__n", "__start")
