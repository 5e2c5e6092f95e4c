"""Shapes of arenas: membership, distance to the wall, masks of bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.binning import grid


class Shape:
    """What is common to shapes; positions are in cm."""

    def is_outside(self, x: Column, y: Column, fudge: float = 0.0) -> Column:
        raise NotImplementedError

    def distance(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def moved(self, dx: float, dy: float) -> Shape:
        raise NotImplementedError

    def mask(self, spark: SparkSession, height: float, width: float, size: float, inner: float | None = None) -> DataFrame:
        """``gy, gx, outside, label`` of every bin by its centre.

        ``label`` is 0 outside, and inside 1 at least ``inner`` from the wall and 2
        nearer to it; without ``inner`` it is 1.
        """
        cells = grid(spark, -int(-height // size), -int(-width // size))
        x, y = (F.col("gx") + 0.5) * size, (F.col("gy") + 0.5) * size
        out = self.is_outside(x, y)
        near = F.lit(False) if inner is None else self.distance(x, y) < inner
        return cells.select("gy", "gx", out.alias("outside"), F.when(out, 0).when(near, 2).otherwise(1).alias("label"))


@dataclass(frozen=True)
class Circle(Shape):
    cx: float
    cy: float
    r: float

    def is_outside(self, x: Column, y: Column, fudge: float = 0.0) -> Column:
        dx, dy = x - self.cx, y - self.cy
        return dx * dx + dy * dy > (self.r + fudge) ** 2

    def distance(self, x: Column, y: Column) -> Column:
        """Distance to the wall, negative outside."""
        return self.r - F.hypot(x - self.cx, y - self.cy)

    def moved(self, dx: float, dy: float) -> Circle:
        return Circle(self.cx + dx, self.cy + dy, self.r)


@dataclass(frozen=True)
class Rectangle(Shape):
    x1: float
    x2: float
    y1: float
    y2: float

    def is_outside(self, x: Column, y: Column, fudge: float = 0.0) -> Column:
        """Points on the wall are inside."""
        return (x < self.x1 - fudge) | (x > self.x2 + fudge) | (y < self.y1 - fudge) | (y > self.y2 + fudge)

    def distance(self, x: Column, y: Column) -> Column:
        """Distance to the nearest line of the wall."""
        return F.least(F.abs(x - self.x1), F.abs(x - self.x2), F.abs(y - self.y1), F.abs(y - self.y2))

    def moved(self, dx: float, dy: float) -> Rectangle:
        return Rectangle(self.x1 + dx, self.x2 + dx, self.y1 + dy, self.y2 + dy)
