"""Stories end to end: after curation, and from an itinerary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from albumforge.functions import text as tx
from albumforge.operators import curation as cu
from albumforge.operators import documents as doc
from albumforge.operators import itinerary as it
from albumforge.operators import story as st
from albumforge.session import cut_lineage


@dataclass
class Story:
    """Chapters with day and title, one cover row per library, and the frames with their start times."""

    chapters: DataFrame
    covers: DataFrame
    frames: DataFrame


def build_story(located: DataFrame, shown: DataFrame, meta: DataFrame, countries: DataFrame, library_id: str = "library_id") -> Story:
    """A story of chapters that have places.

    ``shown``: chapter photos (``pos``, ``orientation``, ``quality``). ``meta``:
    one row per library with ``photos`` and the trip's ``start_date`` and
    ``end_date``. ``countries``: the country that the trip is named after.
    """
    named = st.name_chapters(located, library_id)
    facts = meta.join(countries.select(library_id, "country"), library_id, "left").join(st.travelled_km(located, library_id), library_id)
    covers = facts.select(
        library_id, tx.trip_name(F.col("start_date"), F.col("end_date"), F.col("country")).alias("trip_name"),
        tx.date_range_label(F.col("start_date"), F.col("end_date")).alias("dates"), st.headline(F.col("distance_km"), F.col("photos"))["value"].alias("stat"))
    shots = st.frames(named, st.divider_photos(shown), st.card_layouts(shown, named), covers, library_id)
    return Story(named, covers, st.frame_starts(shots, library_id))


def curated_story(located: DataFrame, chapter_photos: DataFrame, kept: DataFrame, meta: DataFrame, library_id: str = "library_id") -> Story:
    """The story over kept photos only.

    Empty chapters go, and days are counted anew; a lead photo that went is
    replaced by the first photo left. Places stay as they were found, and the
    trip is named after the last country of the whole story, so nothing is looked
    up again. Dates and the number of photos stay those of the whole trip.
    """
    shown = cut_lineage(cu.curated_photos(chapter_photos, kept, library_id))
    chapters = cut_lineage(cu.curated_chapters(located, chapter_photos, kept, library_id))
    # A library that kept nothing has no story.
    return build_story(chapters, shown, meta.join(chapters.select(library_id).distinct(), library_id, "left_semi"), st.last_country(located, library_id), library_id)


def itinerary_story(photos: DataFrame, events: DataFrame, trips: DataFrame, new_order: DataFrame | None = None, tz: str = "UTC",
                    library_id: str = "library_id") -> tuple[DataFrame, DataFrame]:
    """(chapters, rows) of a story along an itinerary: photos matched to events and placed, chapters reordered where asked, one row per shown photo."""
    placed = cut_lineage(it.place_in_events(it.match_events(photos, events, tz, library_id), library_id))
    if new_order is not None:
        placed = cut_lineage(it.reorder(placed, new_order, library_id))
    chapters = it.event_chapters(placed, events, library_id)
    return chapters, doc.story_rows(placed, chapters, trips)
