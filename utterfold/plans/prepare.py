"""From a file to labelled, encoded, split rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MULTILABEL, CorpusConfig, require_column, validate_config
from ..functions.text import clean_basic
from ..operators.cleanup import apply_cleanup
from ..operators.labels import (
    CONTENT,
    build_label_map,
    encode_multiclass,
    encode_with_content,
    unpack_labels,
    unseen_labels,
)
from ..operators.split import split_exact
from ..session import cut_lineage
from ..sources.files import read_corpus


@dataclass
class PreparedCorpus:
    train: DataFrame
    validation: DataFrame | None
    label_map: DataFrame
    #: ``label, n_rows`` of the labels a given map lacks; None if the map was built here.
    unseen: DataFrame | None = None


def load_corpus(spark: SparkSession, config: CorpusConfig) -> DataFrame:
    """Read, unpack and clean as configured; incomplete rows are dropped."""
    validate_config(config)
    df = read_corpus(spark, config.path, config.file_type, config.columns)
    require_column(df.columns, config.text_col, "text")
    if config.label_col:
        require_column(df.columns, config.label_col, "label")
    if config.unpack:
        df = unpack_labels(df, config.label_col, config.delimiter, config.null_label)
    return apply_cleanup(df, clean_basic, [config.text_col])


def prepare(
    df: DataFrame,
    config: CorpusConfig,
    label_map: DataFrame | None = None,
    row_id: str | None = None,
) -> PreparedCorpus:
    """Encode and split a loaded corpus.

    Multilabel rows are regrouped by text first, so equal texts never straddle
    the split; their content ids are its keys. Multiclass rows are split by ``row_id``,
    which is needed because texts may repeat. Rows whose labels a given map lacks are
    dropped or lose that label; ``unseen`` says which.
    """
    unseen = None
    if label_map is None:
        label_map = build_label_map(df, config.label_col)
    else:
        unseen = unseen_labels(df, label_map, config.label_col)
    text = config.text_col
    if config.task == MULTILABEL:
        encoded = encode_with_content(df, label_map, text, config.label_col)
        keys = [CONTENT]
    else:
        encoded = encode_multiclass(df, label_map, config.label_col)
        keys = [row_id] if row_id else None
    if keys is None and 0 < config.validation_ratio < 1:
        raise ValueError("splitting a multiclass corpus needs a row_id column")
    # read by the search for the cut, by the fit and by the evaluation
    encoded = cut_lineage(encoded)
    train, validation = split_exact(encoded, config.validation_ratio, keys or [], config.seed)
    wanted = [F.col(text), F.col("labels")]
    if validation is not None:
        validation = validation.select(*wanted)
    return PreparedCorpus(train.select(*wanted), validation, label_map, unseen)
