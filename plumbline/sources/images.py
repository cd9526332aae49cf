"""Image files to feature rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FIELDS = (
    "image_name string, image_mode string, width int, height int, channels int, aspect_ratio double, pixel_count long, "
    "mean_r double, mean_g double, mean_b double, std_r double, std_g double, std_b double, brightness_mean double, "
    "brightness_std double, min_pixel double, max_pixel double, contrast double, entropy double"
)


def image_features(spark: SparkSession, path: str) -> DataFrame:
    """Size, channel and brightness statistics of every image under a path.

    Files are decoded by the image source; each image is reduced within its own task.
    Unreadable files are left out.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                pixels = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float32)
                # The source stores blue, green, red, alpha.
                red, green, blue = (pixels[:, :, i] for i in ((2, 1, 0) if r.nChannels >= 3 else (0, 0, 0)))
                grey = 0.299 * red + 0.587 * green + 0.114 * blue
                share = np.histogram(grey, bins=256, range=(0, 255), density=True)[0] + 1e-12
                low, high = min(c.min() for c in (red, green, blue)), max(c.max() for c in (red, green, blue))
                rows.append((
                    r.origin.rsplit("/", 1)[-1], {1: "L", 3: "RGB", 4: "RGBA"}.get(r.nChannels, "?"), r.width, r.height, 3,
                    r.width / max(r.height, 1), r.width * r.height, *(float(c.mean()) for c in (red, green, blue)),
                    *(float(c.std()) for c in (red, green, blue)), float(grey.mean()), float(grey.std()), float(low), float(high),
                    float(grey.std()), float(-(share * np.log2(share)).sum())))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    return images.mapInPandas(reduce, FIELDS)
