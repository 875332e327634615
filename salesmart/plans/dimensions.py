"""Customer and track dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.operators.lookups import lookup_chain
from salesmart.operators.mapping import apply_mapping
from salesmart.schemas import conform

# Source column, source type, target column, target type.
CUSTOMER_MAPPING = [
    ("customer_id", "int", "CustomerKey", "int"),
    ("first_name", "string", "FirstName", "string"),
    ("last_name", "string", "LastName", "string"),
    ("company", "string", "Company", "string"),
    ("country", "string", "Country", "string"),
    ("city", "string", "City", "string"),
    ("state", "string", "State", "string"),
    ("email", "string", "Email", "string"),
]


def dim_customer(customer: DataFrame) -> DataFrame:
    """One row per customer."""
    return apply_mapping(customer, CUSTOMER_MAPPING)


def dim_track(
    track: DataFrame, album: DataFrame, artist: DataFrame, genre: DataFrame, media_type: DataFrame
) -> DataFrame:
    """One row per track with its album, artist, genre and media type; no track is dropped.

    Artists are attached to albums first, so the track table, the largest, is joined three
    times instead of four.
    """
    artists = artist.select("artist_id", F.col("name").alias("Artist"))
    albums = lookup_chain(
        album.select("album_id", "artist_id", F.col("title").alias("Album")),
        [(artists, "artist_id")],
    ).drop("artist_id")
    genres = genre.select("genre_id", F.col("name").alias("Genre"))
    media = media_type.select("media_type_id", F.col("name").alias("MediaType"))
    tracks = track.select(
        F.col("track_id").alias("TrackKey"),
        F.col("name").alias("Name"),
        F.col("composer").alias("Composer"),
        F.col("milliseconds").alias("Milliseconds"),
        "album_id",
        "genre_id",
        "media_type_id",
    )
    flat = lookup_chain(
        tracks, [(albums, "album_id"), (genres, "genre_id"), (media, "media_type_id")]
    )
    return conform(flat, "dim_track")
