"""The data model: a stack of equally sized images as one relation pixels(image_id, y, x, c0..c3)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Raster:
    """px has image_id, y, x and a column for each channel: INT samples (bits 8 or 16) or DOUBLE ones from 0 to 1."""

    px: DataFrame
    width: int
    height: int
    channels: int = 3
    bits: str = "8"

    def __post_init__(self) -> None:
        if not 1 <= self.channels <= 4:
            raise ValueError("an image has 1 to 4 channels")
        if self.width < 1 or self.height < 1:
            raise ValueError("an image has at least one pixel")

    @property
    def names(self) -> list[str]:
        return [f"c{k}" for k in range(self.channels)]

    @property
    def top(self) -> float:
        """The largest sample."""
        return {"8": 255, "16": 65535, "double": 1.0}[self.bits]

    @property
    def has_alpha(self) -> bool:
        return self.channels in (2, 4)

    @property
    def colour_names(self) -> list[str]:
        return self.names[: self.channels - self.has_alpha]

    def with_px(self, px: DataFrame, **changes) -> Raster:
        return replace(self, px=px, **changes)

    def project(self, columns: dict[str, Column], **changes) -> Raster:
        """Channels replaced by expressions over this relation's columns; the channel count follows where given."""
        out = replace(self, **changes)
        return replace(out, px=self.px.select(*KEYS, *((columns.get(n, F.col(n) if n in self.px.columns else F.lit(0))).alias(n) for n in out.names)))

    def map_colour(self, f) -> Raster:
        return self.project({n: f(F.col(n)) for n in self.colour_names})

    def map_all(self, f) -> Raster:
        return self.project({n: f(F.col(n)) for n in self.names})

    def sample(self, value: Column) -> Column:
        """A double cut to this stack's samples: truncated and clamped, or clamped only."""
        return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if self.bits == "double" else F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(int(self.top)))


def blank(spark: SparkSession, width: int, height: int, channels: int = 3, bits: str = "8", images: int = 1, colour: tuple = (0, 0, 0, 0)) -> Raster:
    """A stack of images of one colour."""
    grid = spark.range(images).select(F.col("id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    kind = "double" if bits == "double" else "int"
    return Raster(grid.select(*KEYS, *(F.lit(colour[k]).cast(kind).alias(f"c{k}") for k in range(channels))), width, height, channels, bits)


def to_bits(r: Raster, bits: str) -> Raster:
    """Depth conversion: 8 to 16 by 257, back by (n + 128) / 257, doubles by the largest sample and one half."""
    if bits == r.bits:
        return r
    top = {"8": 255, "16": 65535}.get(bits)

    def one(c: Column) -> Column:
        if bits == "double":
            return c / F.lit(float(r.top))
        if r.bits == "double":
            return F.least(F.greatest((c * top + 0.5).cast("int"), F.lit(0)), F.lit(top))
        return c * 257 if bits == "16" else ((c + 128) / 257).cast("int")

    return replace(r.map_all(one), bits=bits)


# Stacks made from the driver's tables.

WIDTH, HEIGHT = 64, 50


def from_embeddings(spark: SparkSession, folder: str, channels: int = 3) -> Raster:
    """64 x 50 images: a row of an image is a vector, a sample trunc((v + 1) * 127.5); further colour channels are the same
    row shifted by one and two, alpha is made from the place and the first channel."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.expr("vec_id div 50").alias("image_id"), (F.col("vec_id") % HEIGHT).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("e")
    )
    px = rows.select("image_id", "y", "e", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    value = lambda k: ((F.element_at("e", (F.col("x") + k) % WIDTH + 1) + 1) * 127.5).cast("int")
    colours = [value(0)] if channels <= 2 else [value(k) for k in range(3)]
    px = px.select(*KEYS, *(c.alias(f"c{k}") for k, c in enumerate(colours)))
    if channels in (2, 4):
        px = px.withColumn(f"c{channels - 1}", F.least(F.lit(255), F.greatest(F.lit(0), (F.col("c0") * 5 + F.col("x") * 3 + F.col("y") * 7) % 300 - 20)))
    return Raster(px, WIDTH, HEIGHT, channels)


def turned(r: Raster) -> Raster:
    """A second stack for joins: the same images turned by half."""
    return r.with_px(r.px.withColumns({"x": (F.lit(r.width - 1) - F.col("x")).cast("int"), "y": (F.lit(r.height - 1) - F.col("y")).cast("int")}))
