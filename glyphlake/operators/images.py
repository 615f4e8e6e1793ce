"""Raw images of cell arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import decoders as D


def raw_images(elements: DataFrame) -> DataFrame:
    """``doc_id, index, element_offset, payload, width, height, local_color_precision, cell_representation_mode``."""
    cells = elements.where("class_id = 4 and element_id = 9").withColumn("c", D.cell_array(F.col("parameters")))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return cells.select("doc_id", index.alias("index"), F.col("offset").alias("element_offset"), "c.payload", "c.width", "c.height", "c.local_color_precision", "c.cell_representation_mode")
