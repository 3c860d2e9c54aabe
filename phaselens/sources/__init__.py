"""Sources (reference CSV, driver Parquet), bindings to the reference
shapes, and sinks."""

from phaselens.sources.bindings import DRIVER_PARAMS, Model, Params
from phaselens.sources.readers import read_parquet_table, read_reference_csv, register_views
from phaselens.sources.sinks import save_table, write_result

__all__ = ["DRIVER_PARAMS", "Model", "Params", "read_parquet_table", "read_reference_csv", "register_views",
           "save_table", "write_result"]
