"""Conversation ETL: nested sessions to turns, tasks and histories, candidate filters, repairs and keyed metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UTTERANCE = "struct<role:string,content:string,turn_number:bigint>"


def explode_conversation(sessions: DataFrame, keep: list[str]) -> DataFrame:
    """keep, role, content, turn_number: one row an utterance of nested sessions (column conversations); sessions without one give none."""
    return sessions.select(*keep, F.inline("conversations"))


def music_turns(df: DataFrame) -> DataFrame:
    """session_id, user_id, session_date (NULL where malformed), turn, track_id, from nested sessions or rows that were exploded before."""
    keep = ["session_id", "user_id", "session_date"]
    rows = explode_conversation(df, keep) if "conversations" in df.columns else df
    rows = rows.where((F.col("role") == "music") & F.col("content").isNotNull())
    day = F.col("session_date") if dict(rows.dtypes)["session_date"] == "date" else F.try_to_date("session_date", "yyyy-MM-dd")
    return rows.select("session_id", "user_id", day.alias("session_date"), F.col("turn_number").alias("turn"), F.col("content").alias("track_id"))


def assemble_turns(utterances: DataFrame, roles: tuple[str, ...] = ("user", "music", "assistant")) -> DataFrame:
    """session_id, turn_number and a column per role, of turns that have every role.

    One grouped pass with conditional aggregates in place of a join per role; of several utterances of a
    role in a turn the smallest text counts.
    """
    said = [F.min(F.when(F.col("role") == r, F.col("content"))).alias(r) for r in roles]
    return utterances.groupBy("session_id", "turn_number").agg(*said).na.drop(subset=list(roles))


def turn_tasks(utterances: DataFrame) -> DataFrame:
    """session_id, turn_number, query, n_prior, prior: a task for every user turn, with the tracks of the turns before it in order."""
    before = Window.partitionBy("session_id").orderBy("turn_number").rangeBetween(Window.unboundedPreceding, -1)
    prior = F.collect_list(F.when(F.col("role") == "music", F.struct(F.col("turn_number").alias("t"), F.col("content").alias("c")))).over(before)
    rows = utterances.withColumn("_p", F.transform(F.array_sort(prior), lambda x: x["c"]))
    return rows.where("role = 'user'").select("session_id", "turn_number", F.col("content").alias("query"), F.size("_p").alias("n_prior"), F.col("_p").alias("prior"))


def session_history(inter: DataFrame) -> DataFrame:
    """session_id, turn, track_id, is_target: what was heard before the last turn, and the last turn itself without its track."""
    last = F.max("turn").over(Window.partitionBy("session_id"))
    rows = inter.withColumn("is_target", F.col("turn") == last)
    return rows.select("session_id", "turn", F.when(~F.col("is_target"), F.col("track_id")).alias("track_id"), "is_target")


def query_texts(utterances: DataFrame, names: DataFrame) -> DataFrame:
    """session_id, turn_number and four texts a user turn can ask with.

    current: its words; history: all words of the user so far; weighted: its words twice, then the earlier
    ones; tracks: its words and the names (track_id, name) of the tracks of earlier turns in order.
    """
    before = Window.partitionBy("session_id").orderBy("turn_number").rangeBetween(Window.unboundedPreceding, -1)
    named = utterances.join(names.select(F.col("track_id").cast("string").alias("content"), F.lit("music").alias("role"), "name"), ["role", "content"], "left")
    held = lambda role, text: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct(F.col("turn_number").alias("t"), F.col(text).alias("c")))).over(before)), lambda x: x["c"])
    rows = named.withColumns({"_said": held("user", "content"), "_heard": held("music", "name")}).where("role = 'user'")
    text = lambda *parts: F.concat_ws(" ", *parts)
    return rows.select("session_id", "turn_number", F.col("content").alias("current"), text("_said", "content").alias("history"), text("content", "content", "_said").alias("weighted"), text("content", "_heard").alias("tracks"))


def blind_turn(conversations: Column) -> Column:
    """The turn that a cut-off session of three utterances a turn asks for."""
    return F.floor((F.size(conversations) + 2) / 3).cast("long")


def progress_labels(tasks: DataFrame, assessments: DataFrame) -> DataFrame:
    """session_id, turn, track_id, progress: MOVES, DOES_NOT or NULL, from the assessment of the track's own turn."""
    said = assessments.select("session_id", "turn", F.upper("assessment").alias("_a"))
    label = F.when(F.col("_a").startswith("MOVES"), "MOVES").when(F.col("_a").startswith("DOES_NOT"), "DOES_NOT")
    return tasks.join(said, ["session_id", "turn"], "left").select("session_id", "turn", "track_id", label.alias("progress"))


def repaired(df: DataFrame, columns: list[str]) -> DataFrame:
    """Candidate rows in a fixed schema: `turn` taken from gt_turn_number where that is there, helper columns dropped, order set."""
    if "gt_turn_number" in df.columns:
        df = df.withColumn("turn", F.col("gt_turn_number"))
    return df.select(*columns)


def keep_known(candidates: DataFrame, blind: DataFrame, allowed: DataFrame, keys: list[str], item: str, is_gt: Column) -> DataFrame:
    """Candidates of blind groups that are allowed or true; all candidates of the other groups."""
    rows = candidates.join(blind.select(*keys).distinct().withColumn("_blind", F.lit(True)), keys, "left")
    rows = rows.join(allowed.select(item).distinct().withColumn("_known", F.lit(True)), item, "left")
    return rows.where(F.col("_blind").isNull() | F.col("_known").isNotNull() | F.coalesce(is_gt, F.lit(False))).select(*candidates.columns)


def allow_list(catalogue: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Catalogue rows on the list; an error where none is."""
    kept = catalogue.join(allowed.select(key).distinct(), key, "left_semi")
    if kept.isEmpty():
        raise ValueError("the allow-list matches no row of the catalogue")
    return kept


def released_by(release: Column, session_date: Column, years: float | None = None) -> Column:
    """Whether a track may be proposed: released by the session's date, strictly for None (undated ones go), else up to int(365 * years) days later (undated ones stay)."""
    if years is None:
        return F.coalesce(release <= session_date, F.lit(False))
    return release.isNull() | F.coalesce(release <= F.date_add(session_date, int(365 * years)), F.lit(False))


def flat_metadata(tracks: DataFrame) -> DataFrame:
    """track_id, track, artist, album, year, n_tags from list-valued metadata: first names, the date's first four digits."""
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    year = F.substring("release_date", 1, 4).try_cast("int")
    return tracks.select("track_id", first("track_name").alias("track"), first("artist_name").alias("artist"), first("album_name").alias("album"), F.when(year > 0, year).cast("long").alias("year"), F.greatest(F.size("tag_list"), F.lit(0)).cast("long").alias("n_tags"))


def album_key(artist: Column, album: Column) -> Column:
    """artist::album; NULL for a missing, blank or unknown album."""
    name = F.trim(album)
    return F.when(~F.lower(name).isin("", "unknown", "none"), F.concat_ws("::", F.coalesce(artist, F.lit("")), name))


def undated(release: Column) -> Column:
    """Whether a release date is missing: NULL, blank or NaN as text."""
    return F.coalesce(F.lower(F.trim(release.cast("string"))).isin("", "nan", "none", "nat"), F.lit(True))


def or_empty(value: Column) -> Column:
    """A text field with NULL, blank and 'None' as ''."""
    return F.when(F.lower(F.trim(value)).isin("", "none"), "").otherwise(F.coalesce(value, F.lit("")))


def first_of_union(parts: list[DataFrame], keys: list[str], fill: list[str]) -> DataFrame:
    """One row a key: that of the first part that has it, its NULLs in `fill` taken from later parts."""
    every = None
    for k, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(k))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    others = [c for c in every.columns if c not in (*keys, *fill, "_part")]
    firsts = F.min_by(F.struct(*others), "_part").alias("_first")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_part"))).alias(c) for c in fill]
    return every.groupBy(*keys).agg(firsts, *filled).select(*keys, "_first.*", *fill)


def patched(df: DataFrame, truth: DataFrame, keys: list[str], column: str) -> DataFrame:
    """df with NULLs of a column taken from truth."""
    right = truth.select(*keys, F.col(column).alias("_t"))
    return df.join(right, keys, "left").withColumn(column, F.coalesce(column, "_t")).drop("_t")


def dense_index(df: DataFrame, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """df with `name`: the place from 0 of its order columns' values among the distinct ones; the first is numeric.

    Two levels: ranges of the first column are counted and summed up (`buckets` rows in one task), and
    ranks are taken within a range.
    """
    lead = F.col(order[0]).cast("double")
    ends = df.agg(F.min(lead).alias("_lo"), F.max(lead).alias("_hi"))
    part = F.coalesce(F.floor(F.try_divide(lead - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (buckets - 1)), F.lit(0))
    keyed = df.crossJoin(F.broadcast(ends)).withColumn("_b", part).drop("_lo", "_hi")
    before = keyed.select("_b", *order).distinct().groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    inside = F.dense_rank().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return keyed.withColumn(name, inside).join(F.broadcast(before), "_b").withColumn(name, (F.col(name) + F.col("_first")).cast("long")).drop("_b", "_first")


def dominant_pair(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, a, b, n: each key's most frequent pair; ties go to the larger pair."""
    pairs = df.groupBy(key, a, b).agg(F.count("*").alias("n"))
    return pairs.groupBy(key).agg(F.max(F.struct("n", a, b)).alias("_m")).select(key, f"_m.{a}", f"_m.{b}", "_m.n")


def mode_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, column: the most frequent value that isn't NULL; ties go to the smaller."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def first_known(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys, the largest order value, and each column's first value that isn't NULL in that order."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(*keys).agg(F.max(order).alias(f"max_{order}"), F.count("*").alias("n"), *firsts)


def sampled_groups(df: DataFrame, keys: list[str], n: int, protected: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """Rows of the n groups of smallest hash, and of the protected groups besides."""
    groups = df.select(*keys).distinct()
    pick = groups.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).orderBy("_h", *keys).limit(n).select(*keys)
    if protected is not None:
        pick = pick.unionByName(protected.select(*keys)).distinct()
    return df.join(pick, keys, "left_semi")


def filled_or_error(short: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """The lists, checked: an error where a group has fewer than k items."""
    few = short.groupBy(*keys).agg(F.countDistinct(item).alias("n")).where(F.col("n") < k)
    if found := few.limit(1).collect():
        raise ValueError(f"too few items for {found[0].asDict()}: {k} are needed")
    return short


def canonical(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rows of a group side by side and in order within a file; no total order over files."""
    return df.repartition(*keys).sortWithinPartitions(*keys, item)


def ordinal(train: DataFrame, df: DataFrame, column: str, name: str) -> DataFrame:
    """df with `name`: the place from 1 of the value among the training values in order, 0 for values unknown there."""
    values = train.select(column).where(F.col(column).isNotNull()).distinct()
    places = values.withColumn(name, F.row_number().over(Window.orderBy(column)).cast("long"))  # one row a category
    return df.join(places, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def leakage_safe(inter: DataFrame, part: str) -> DataFrame:
    """The interactions that a part may learn from: training ones; validation adds its training side; all for blind sessions."""
    allowed = {"train": ["train"], "val": ["train", "val"], "holdout": ["train", "val"], "blind": ["train", "val", "holdout"]}
    return inter.where(F.col("bucket").isin(allowed[part]))


def user_vectors(users: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """users with the first non-empty vector of theirs at length 1, and is_cold where there is none."""
    from tessera.functions.columns import norm

    some = vectors.where(F.size(vector) > 0).groupBy(key).agg(F.min_by(vector, "place").alias("_v"))
    length = norm(F.col("_v"))
    rows = users.join(some, key, "left").withColumn("vector", F.when(length > 0, F.transform("_v", lambda x: x / length)).otherwise(F.col("_v")))
    return rows.withColumn("is_cold", F.col("_v").isNull()).drop("_v")


def masked_tower(catalogue: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Every catalogue key with its vector and `valid`; missing, empty and all-zero vectors aren't valid and are NULL."""
    good = vectors.where(F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))).select(key, vector)
    return catalogue.select(key).join(good, key, "left").withColumn("valid", F.col(vector).isNotNull())


def best_trial(trials: DataFrame, keys: list[str], value: str, params: list[str]) -> DataFrame:
    """keys, value, params of the completed trial of largest value; ties go to the smaller parameters."""
    done = trials.where(F.col(value).isNotNull())
    return done.groupBy(*keys).agg(F.min_by(F.struct(value, *params), F.struct(-F.col(value), *params)).alias("_b")).select(*keys, "_b.*")


def top_trials(trials: DataFrame, value: str, params: list[str], k: int) -> DataFrame:
    """params, value, rank: the k best distinct settings, each by its best trial."""
    from tessera.operators.ranking import topk_per_group

    best = trials.where(F.col(value).isNotNull()).groupBy(*params).agg(F.max(value).alias(value))
    return topk_per_group(best.withColumn("_all", F.lit(0)).orderBy(F.col(value).desc(), *params).limit(k), ["_all"], [F.col(value).desc(), *map(F.col, params)], k).drop("_all")


def fold_plan(counts: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, int]]:
    """(size, first place, last place, fold): greedy bin packing of equal users by size, largest first, each to the lightest fold.

    `counts` are (sessions, users) pairs, few of them. Of users of one size only their number matters:
    once the folds differ by less than that size they take turns, so a size needs a few steps and one
    repeated round, whatever its number of users. A row with last place -1 repeats every `folds` places.
    """
    load, out = [0] * folds, []
    lightest = lambda: sorted(range(folds), key=lambda k: (load[k], k))
    for size, n in sorted(counts, reverse=True):
        place = 0
        while place < n and max(load) - min(load) >= size:
            f = lightest()[0]
            out.append((size, place, place, f))
            load[f] += size
            place += 1
        for j, f in enumerate(lightest() if place < n else ()):
            out.append((size, place + j, -1, f))
            load[f] += size * len(range(j, n - place, folds))
    return out


def assigned_folds(users: DataFrame, user: str, size: str, folds: int, seed: str) -> DataFrame:
    """user, size, fold: users of each size in the order of a hash, dealt by fold_plan. One count a size passes the driver."""
    from tessera.functions.columns import uniform01

    counts = [(r[0], r[1]) for r in users.groupBy(size).count().collect()]
    plan = users.sparkSession.createDataFrame(fold_plan(counts, folds), f"`{size}` long, first long, last long, fold long")
    order = Window.partitionBy(size).orderBy(uniform01(F.col(user), seed), user)
    placed = users.select(user, F.col(size).cast("long"), (F.row_number().over(order) - 1).alias("_p"))
    hit = (F.col("last") >= 0) & (F.col("_p") == F.col("first")) | (F.col("last") < 0) & (F.col("_p") >= F.col("first")) & ((F.col("_p") - F.col("first")) % folds == 0)
    return placed.join(F.broadcast(plan), size).where(hit).select(user, size, "fold")
