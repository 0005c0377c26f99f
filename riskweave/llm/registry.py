"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .ann import op7_ann
from .bpe import op10_bpe
from .collocations import op12_collocations
from .embedding_dedup import op9_embedding_dedup
from .extraction import op3_html
from .language import op8_language
from .lexical import op13_search
from .licences import op11_licences
from .minhash import op1_minhash
from .packing import op6_packing
from .quality import op4_quality
from .sql import texts
from .suffix import op2_suffix_array
from .toxicity import op5_toxicity


def ship(spark: SparkSession) -> None:
    """Give the executors this code, as ``--py-files`` would, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(corpus_pipeline.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="code-")) / "riskweave_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in (top / "corpus_pipeline.py", *sorted((top / "riskweave").rglob("*.py"))):
                out.write(path, path.relative_to(top))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def _shipped(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_minhash": op1_minhash,
        "op2_suffix_array": op2_suffix_array,
        "op3_html": op3_html,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_packing": op6_packing,
        "op7_ann": op7_ann,
        "op8_language": op8_language,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_bpe": op10_bpe,
        "op11_licences": op11_licences,
        "op12_collocations": op12_collocations,
        "op13_search": op13_search,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return texts()
