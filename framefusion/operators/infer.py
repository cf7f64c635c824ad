"""Distributed inference hook: a user's recogniser over regions, one model per Python worker."""

from __future__ import annotations

from typing import Any, Callable, Iterable, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Recogniser(Protocol):
    def predict_many(self, crops: list[Any]) -> Iterable[Iterable[tuple[str, float]]]: ...


def score_regions(regions: DataFrame, load: Callable[[], Recogniser], crop: Callable[[dict], Any], keep: list[str],
                  min_conf: float = 0.0, max_digits: int | None = None, batch: int = 64) -> DataFrame:
    """Readings of every region. `load` builds the recogniser once per Python worker partition; `crop` turns a region row
    into what the recogniser takes. Rows stream through in Arrow batches; outputs are (keep…, region_hit, text, conf)."""
    schema = T.StructType([*[regions.schema[k] for k in keep], T.StructField("hit_index", T.IntegerType()),
                           T.StructField("text", T.StringType()), T.StructField("ocr_conf", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        model = load()
        for pdf in batches:
            out = []
            rows = pdf.to_dict("records")
            for start in range(0, len(rows), batch):
                part = rows[start:start + batch]
                for row, found in zip(part, model.predict_many([crop(r) for r in part])):
                    for i, (text, conf) in enumerate(found):
                        if conf >= min_conf and text and (max_digits is None or len(text) <= max_digits):
                            out.append((*[row[k] for k in keep], i, str(text), float(conf)))
            if out:
                yield pd.DataFrame(out, columns=names)

    return regions.mapInPandas(run, schema)
