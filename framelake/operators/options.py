"""A run's settings as one value: a frozen dataclass, and the one-row table it stands for."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config

_REQUEST = "request_id int, preset_name string, crf_spec string, encoder_preset int, film_grain int, film_grain_denoise boolean"


class OptionError(ValueError):
    """code: the first rule that the options fail, as `config.check` names it."""

    def __init__(self, code: str) -> None:
        super().__init__(f"options fail the rule {code}")
        self.code = code


@dataclass(frozen=True)
class EncodeOptions:
    """What a caller sets; None leaves the preset's value.

    Whatever the order in which they are set, the preset comes first, then crf (one value or three, as text; one that can't
    be read is ignored), then the CRF of a band, then the encoder's preset and film grain. crop: detect black bars.
    responsive: leave threads to others; it changes no plan.
    """

    preset: str | None = None
    crf: str | None = None
    crf_sd: int | None = None
    crf_hd: int | None = None
    crf_uhd: int | None = None
    encoder_preset: int | None = None
    film_grain: int | None = None
    film_grain_denoise: bool | None = None
    crop: bool = True
    responsive: bool = False

    def having(self, **changes: Any) -> EncodeOptions:
        """These options with some set otherwise."""
        return replace(self, **changes)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row: all settings once presets and overrides are applied, crop, responsive, and error, the first rule that fails."""
        o = asdict(self)
        row = (0, o["preset"], o["crf"], o["encoder_preset"], o["film_grain"], o["film_grain_denoise"])
        base = config.effective(config.values_table(spark, [row], _REQUEST), keep_defaults=True)
        bands = ("crf_sd", "crf_hd", "crf_uhd")
        own = {c: F.coalesce(F.lit(o[c]).cast("int"), F.col(c)) for c in bands}
        df = base.withColumns(own | {"bad_crf": F.lit(False)})
        df = df.withColumns({"error": config.check(df), "crop": F.lit(self.crop), "responsive": F.lit(self.responsive)})
        boost = config.presets(spark).select("preset", "variance_boost", "boost_strength", "boost_octile")
        return df.drop("request_id", "bad_crf").join(F.broadcast(boost), "preset", "left")

    def resolved(self, spark: SparkSession) -> dict[str, Any]:
        """The settings as values; OptionError if a rule fails."""
        row = self.frame(spark).first().asDict()
        error = row.pop("error")
        if error:
            raise OptionError(error)
        return row
