"""Keep and remove presses, the curated story, and how a session ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.operators.ordering import running, with_positions


def replay(actions: DataFrame, starters: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Final state per touched or starting photo: ``kept``, ``touched`` and ``presses``.

    An action is on, off or flip. The last on/off decides, and every flip after
    it turns the state over; without one, flips start from starter membership.
    Two mergeable aggregates and a join, no ordered walk.
    """
    keys = [library_id, "photo_id"]
    explicit = F.col("action") != "flip"
    when = F.when(explicit, F.col("seq"))
    last = actions.groupBy(*keys).agg(
        F.max(when).alias("_last"), F.max_by((F.col("action") == "on").cast("int"), when).alias("_on"),
        F.count("*").alias("presses"))
    flips = (
        actions.where(~explicit).join(last.select(*keys, "_last"), keys)
        .where(F.col("_last").isNull() | (F.col("seq") > F.col("_last")))
        .groupBy(*keys).agg(F.count("*").alias("_flips"))
    )
    started = starters.select(*keys).distinct().withColumn("_starter", F.lit(True))
    state = last.join(flips, keys, "left").join(started, keys, "full_outer")
    base = F.coalesce(F.col("_on") == 1, F.coalesce("_starter", F.lit(False)))
    odd = F.coalesce(F.col("_flips"), F.lit(0)) % 2 == 1
    return state.select(
        *keys, (base != odd).alias("kept"), F.col("presses").isNotNull().alias("touched"),
        F.coalesce("presses", F.lit(0)).alias("presses"))


def session_counts(actions: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Presses, distinct photos and the final streak per library."""
    off = F.max(F.when(F.col("action") == "off", F.col("seq"))).alias("_off")
    # Presses per photo first, so a library with very many presses is combined in two steps.
    per_photo = actions.groupBy(library_id, "photo_id").agg(F.count("*").alias("_n"), off)
    totals = per_photo.groupBy(library_id).agg(
        F.sum("_n").alias("presses"), F.count("*").alias("distinct_photos"), F.max("_off").alias("_off"))
    after = actions.join(totals.select(library_id, "_off"), library_id).where(
        F.col("_off").isNull() | (F.col("seq") > F.col("_off")))
    streak = after.groupBy(library_id).agg(F.count("*").alias("streak"))
    return totals.drop("_off").join(streak, library_id, "left").fillna(0, ["streak"])


def streaks(actions: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Streak after every press: presses since the last removal."""
    placed = with_positions(actions, [library_id], [F.col("seq").asc()])
    reset = placed.withColumn("_reset", F.when(F.col("action") == "off", F.col("pos")))
    marked = running(reset, [library_id], "_reset", "_since", "max")
    return marked.withColumn("streak", F.col("pos") - F.coalesce("_since", F.lit(-1))).drop("_reset", "_since")


def curated_chapters(chapters: DataFrame, chapter_photos: DataFrame, kept: DataFrame,
                     library_id: str = "library_id") -> DataFrame:
    """Chapters over kept photos only: empty ones go, a lost lead photo is replaced by the first one left."""
    keys = [library_id, "cluster_idx"]
    left = curated_photos(chapter_photos, kept, library_id).join(
        chapters.select(*keys, "hero_photo_id"), keys)
    own = F.max(F.when(F.col("photo_id") == F.col("hero_photo_id"), F.col("photo_id")))
    picks = left.groupBy(*keys).agg(
        F.count("*").alias("photo_count"),
        F.coalesce(own, F.min_by("photo_id", "pos")).alias("hero_photo_id"))
    return chapters.drop("photo_count", "hero_photo_id").join(picks, keys)


def curated_photos(chapter_photos: DataFrame, kept: DataFrame, library_id: str = "library_id") -> DataFrame:
    """Chapter photos, or originals, that are in the kept set."""
    return chapter_photos.drop("hero_photo_id").join(
        kept.select(library_id, "photo_id").distinct(), [library_id, "photo_id"], "left_semi")


def kept_in_time_order(kept_photos: DataFrame, library_id: str = "library_id", order: str = "ordinal") -> DataFrame:
    """Position of each kept photo by time; undated ones count as time 0, ties keep their order."""
    time = F.coalesce(F.unix_millis("ts"), F.lit(0))
    return with_positions(kept_photos, [library_id], [time.asc(), F.col(order).asc()], out="kept_no")


def first_completions(finishes: DataFrame, session: str = "session_id", order: str = "seq") -> DataFrame:
    """The first finish of each session; later ones are not counted again."""
    rest = [c for c in finishes.columns if c != session]
    first = finishes.groupBy(session).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("_f"))
    return first.select(session, "_f.*").select(*finishes.columns)


def bail_outs(leaves: DataFrame, finishes: DataFrame, session: str = "session_id") -> DataFrame:
    """Leaving by Back always counts; closing the tab only when no finish came before."""
    done = finishes.groupBy(session).agg(F.min("seq").alias("_done"))
    joined = leaves.join(done, session, "left")
    counts = (F.col("kind") == "back") | F.col("_done").isNull() | (F.col("_done") > F.col("seq"))
    return joined.where(counts).drop("_done")
