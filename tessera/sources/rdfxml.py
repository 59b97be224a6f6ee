"""RDF/XML ontologies, which are small files, as facts."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _local(uri: str) -> str:
    return uri.rsplit("#", 1)[-1].rsplit("/", 1)[-1]


def triples(text: str) -> list[tuple[str, str, str]]:
    """subject, verb, object by local names; a typed node gives its type, too."""
    found = []
    for node in ElementTree.fromstring(text):
        subject = _local(node.get(f"{RDF}about") or node.get(f"{RDF}ID") or node.get(f"{RDF}nodeID") or "")
        if _name(node.tag) != "Description":
            found.append((subject, "type", _name(node.tag)))
        for p in node:
            target = p.get(f"{RDF}resource")
            found.append((subject, _name(p.tag), _local(target) if target else (p.text or "").strip()))
    return found


def parsed(texts: DataFrame, column: str = "value") -> DataFrame:
    """subject, verb, object of a column of RDF/XML documents, one document per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for text in batch.column(0).to_pylist() if text for t in triples(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["subject", "verb", "object"])

    return texts.select(column).mapInArrow(run, "subject string, verb string, object string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All files at a path, each one document, read through Spark and so from any store it knows."""
    return parsed(spark.read.text(path, wholetext=True))
