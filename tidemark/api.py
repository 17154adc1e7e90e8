"""The public names."""

from .functions.native import make_robust
from .metrics import get_feature_logs, get_function_stats, get_processor_logs, get_series_names_stats
from .model import FeatureDescriptor, FuncWrapper, Grouped, MultipleFeatureDescriptors, Series, SeriesSet
from .operators.chunking import chunk_data
from .operators.collection import FeatureCollection, concat_rows, join_on_index, outer_merge
from .operators.processing import SeriesPipeline, SeriesProcessor, dataframe_func, elementwise, on_series, process_chunks

__all__ = [n for n in dir() if not n.startswith("_")]
