"""Values inside JSON and XML documents and maps."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import reduce
from operator import add
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Functions for executors travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _value(document: Column, path: str) -> tuple[Column, Column]:
    """The value at a JSON path without ``[*]``, and the name of its type; null if the document or the path can't be read."""
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return value, F.schema_of_variant(value)


def json_number(document: Column, path: str) -> Column:
    """A number at a JSON path; null if there is none. Quoted digits are text, not a number."""
    _, kind = _value(document, path)
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.get_json_object(document, path).try_cast("double"))


def json_text(document: Column, path: str) -> Column:
    """Text, number or object at a JSON path, as text; booleans, and what isn't there, are null."""
    _, kind = _value(document, path)
    return F.when(kind != "BOOLEAN", F.get_json_object(document, path))


def json_list(document: Column, path: str, item: str = "string") -> Column:
    """The list at a JSON path, or that a path with ``[*]`` selects; a single value is a list of one."""
    found = F.get_json_object(document, path)
    several = F.from_json(found, f"array<{item}>")
    return F.when(F.startswith(found, F.lit("[")), several).when(found.isNotNull(), F.array(found.try_cast(item)))


def xml_text(document: Column, path: str) -> Column:
    """Text of the first match of an XPath, empty if there is none; malformed documents are an error."""
    return F.xpath_string(document, F.lit(path))


def xml_number(document: Column, path: str) -> Column:
    """Number that an XPath gives; NaN if it is none."""
    return F.xpath_number(document, F.lit(path))


def xml_texts(document: Column, path: str) -> Column:
    """Texts of all matches of an XPath."""
    return F.xpath(document, F.lit(path))


def xml_node(document: Column, path: str) -> Column:
    """The first matching element as XML text, null if there is none; paths of child, descendant and index steps."""
    return xml_fields(document, node=("node", path))["node"]


def xml_fields(document: Column, **wanted: tuple[str, str]) -> Column:
    """A struct of several values of a document: by name a kind (text, number, texts, node) and an XPath.

    The values are those of ``xml_text``, ``xml_number``, ``xml_texts`` and ``xml_node``, but the document is parsed once, which
    matters: an XPath of Spark parses it for each value. That way go paths ``//name``, ``/name/name`` (also with ``/text()``, or
    inside ``count`` or ``sum``), in documents without declarations, comments, CDATA and name spaces; others go Spark's way.
    """
    known = {name: (kind, *_readers(kind, path)) for name, (kind, path) in wanted.items() if kind == "node" or _readers(kind, path)}
    whole = any(kind == "node" for kind, *_ in known.values())

    @F.pandas_udf(", ".join(f"`{name}` {_TYPES[kind]}" for name, (kind, *_) in known.items()))
    def values(documents: pd.Series, plain: pd.Series) -> pd.DataFrame:
        out = {name: [None] * len(documents) for name in known}
        for i, (text, simple) in enumerate(zip(documents, plain)):
            if text is None or not (simple or whole):
                continue
            root = ElementTree.Element("root")  # so that a path may name the document's own element
            root.append(ElementTree.fromstring(text))
            for name, (kind, read) in known.items():
                if simple or kind == "node":
                    out[name][i] = read(root)
        return pd.DataFrame({name: pd.Series(found, dtype="object") for name, found in out.items()})

    plain = (document != "") & ~document.rlike(_ODD)
    one_pass = values(document, plain) if known else None
    native = {"text": xml_text, "number": xml_number, "texts": xml_texts}
    fields = []
    for name, (kind, path) in wanted.items():
        if name not in known:
            value = native[kind](document, path)
        elif kind == "node":
            value = one_pass[name]
        else:
            read = F.coalesce(one_pass[name], F.lit(float("nan"))) if kind == "number" else one_pass[name]  # NaN comes from pandas as null
            value = F.when(plain, read).otherwise(native[kind](document, path))
        fields.append(value.alias(name))
    return F.struct(*fields)


_TYPES = {"text": "string", "number": "double", "texts": "array<string>", "node": "string"}
#: Declarations, comments, CDATA, and colons in names.
_ODD = r"""<[!?]|xmlns|<(?:[^<>"':]++|"[^"]*+"|'[^']*+')*+:"""
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
_STEPS = rf"(//{_NAME}|(?:/{_NAME})+)(/text\(\))?"
_PATH = re.compile(rf"{_STEPS}|(count|sum)\({_STEPS}\)")
_NUMBER = re.compile(r"[ \t\r\n]*(-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))[ \t\r\n]*")


def _readers(kind: str, path: str) -> tuple[Callable[[ElementTree.Element], object]] | None:
    """How to read a value of a kind from below a root element; none for paths that are left to Spark's XPath."""
    if kind == "node":
        steps = re.sub(r"^/+", lambda m: ".//" if len(m[0]) > 1 else "./", path)

        def node(root: ElementTree.Element) -> str | None:
            found = root.find(steps)
            if found is None:
                return None
            found.tail, tail = None, found.tail
            text = ElementTree.tostring(found, encoding="unicode")
            found.tail = tail
            return text

        return (node,)
    parts = _PATH.fullmatch(path)
    if not parts:
        return None
    function, steps, texts = parts[3], "." + (parts[1] or parts[4]), bool(parts[2] or parts[5])
    if (function and kind != "number") or (kind == "texts" and not texts):
        return None

    def strings(root: ElementTree.Element) -> list[str]:
        found = root.findall(steps)
        if not texts:
            return ["".join(e.itertext()) for e in found]
        return [e.text for e in found if e.text] if not any(map(len, found)) else _text_nodes(root, set(found))

    readers = {
        "count": lambda root: float(len(strings(root) if texts else root.findall(steps))),
        "sum": lambda root: reduce(add, map(_number, strings(root)), 0.0),  # Python's own sum rounds otherwise
        "number": lambda root: _number(next(iter(strings(root)), "")),
        "text": lambda root: next(iter(strings(root)), ""),
        "texts": strings,
    }
    return (readers[function or kind],)


def _number(text: str) -> float:
    found = _NUMBER.fullmatch(text)
    return float(found[1]) if found else float("nan")


def _text_nodes(root: ElementTree.Element, owners: set[ElementTree.Element]) -> list[str]:
    """The texts directly inside some elements, in the document's order."""
    out, todo = [], [(root, None)]
    while todo:
        element, text = todo.pop()
        if element is None:
            out.append(text)
            continue
        if element in owners and element.text:
            out.append(element.text)
        for child in reversed(element):
            if element in owners and child.tail:
                todo.append((None, child.tail))
            todo.append((child, None))
    return out


def metadata(log: DataFrame, key: str) -> Column:
    """Metadata of a key, null if it is missing; a source that keeps the key as a column of its own lets scans filter on it."""
    return F.col(f"`metaData.{key}`") if f"metaData.{key}" in log.columns else F.try_element_at("metaData", F.lit(key))


def map_text(value: Column) -> Column:
    """Text form of a map or object."""
    return F.to_json(value)
