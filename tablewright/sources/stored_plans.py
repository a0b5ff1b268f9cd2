"""Versioned storage of fitted objects: parameters, lookup tables and Spark ML models.

A version is a folder of its own with ``manifest.json`` (all parameters, as a tree of parts),
``tables/`` (Parquet) and ``models/`` (Spark ML). It counts only once its marker under
``_versions`` exists; a marker is created, never replaced, so writers that race get different
numbers and a broken save is never read. Any object decorated with ``storable`` can be stored,
with everything inside it.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import decimal
import io
import json
import math
import uuid
from collections.abc import Sequence
from importlib import import_module

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.operators.schema import small_frame

FORMAT = 1
_PACKAGE = __name__.split(".")[0]
_FIELDS: dict[type, tuple[str, ...]] = {}


def storable(cls: type | None = None, *, fields: Sequence[str] | None = None):
    """Class decorator; ``fields`` names the constructor's arguments where the class is no dataclass."""

    def register(target: type) -> type:
        _FIELDS[target] = tuple(fields) if fields else tuple(f.name for f in dataclasses.fields(target) if f.init)
        return target

    return register if cls is None else register(cls)


# --- files -----------------------------------------------------------------------


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new small file; False if one is there already."""
    fs, where = _file(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in type(error.java_exception).__name__ or "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, where = _file(spark, path)
    fs.delete(where, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where))


# --- values ----------------------------------------------------------------------


class _Writer:
    """Turns an object into JSON and writes its tables and models beside it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.count = spark, folder, 0

    def _place(self, kind: str) -> str:
        self.count += 1
        return f"{kind}/{self.count:04d}"

    def encode(self, value):
        if value is None or isinstance(value, (bool, str)):
            return value
        if isinstance(value, (np.bool_, np.integer, np.floating)):
            value = value.item()
        if isinstance(value, int):
            return value
        if isinstance(value, float):
            return value if math.isfinite(value) else {"$float": repr(value)}
        if isinstance(value, decimal.Decimal):
            return {"$decimal": str(value)}
        if isinstance(value, dt.datetime):
            return {"$datetime": value.isoformat()}
        if isinstance(value, dt.date):
            return {"$date": value.isoformat()}
        if isinstance(value, (tuple, list, set, frozenset)):
            items = sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value
            return {f"${type(value).__name__}": [self.encode(v) for v in items]}
        if isinstance(value, dict):
            return {"$dict": [[self.encode(k), self.encode(v)] for k, v in value.items()]}
        if isinstance(value, np.ndarray):
            held = io.BytesIO()
            np.save(held, value, allow_pickle=False)
            return {"$array": base64.b64encode(held.getvalue()).decode()}
        if isinstance(value, DataFrame):
            place = self._place("tables")
            value.write.parquet(f"{self.folder}/{place}")
            return {"$table": place, "schema": json.loads(value.schema.json())}
        if type(value) in _FIELDS:
            kind = type(value)
            return {"$part": f"{kind.__module__}:{kind.__qualname__}", "fields": {f: self.encode(getattr(value, f)) for f in _FIELDS[kind]}}
        if isinstance(value, MLWritable):
            place = self._place("models")
            value.write().save(f"{self.folder}/{place}")
            return {"$model": place, "class": f"{type(value).__module__}:{type(value).__qualname__}"}
        raise TypeError(f"{type(value).__name__} cannot be stored; decorate its class with storable")


class _Reader:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @staticmethod
    def _class(name: str, package: str) -> type:
        module, _, qualified = name.partition(":")
        if module.split(".")[0] != package.split(".")[0] or not (module + ".").startswith(package + "."):
            raise ValueError(f"{name!r} does not belong to {package!r}")
        return getattr(import_module(module), qualified)

    def decode(self, value):
        if not isinstance(value, dict):
            return value
        kind, inner = next(iter(value.items()))
        if kind in ("$tuple", "$list", "$set", "$frozenset"):
            items = [self.decode(v) for v in inner]
            return {"$tuple": tuple, "$list": list, "$set": set, "$frozenset": frozenset}[kind](items)
        if kind == "$dict":
            return {self.decode(k): self.decode(v) for k, v in inner}
        if kind == "$float":
            return float(inner)
        if kind == "$decimal":
            return decimal.Decimal(inner)
        if kind == "$datetime":
            return dt.datetime.fromisoformat(inner)
        if kind == "$date":
            return dt.date.fromisoformat(inner)
        if kind == "$array":
            return np.load(io.BytesIO(base64.b64decode(inner)), allow_pickle=False)
        if kind == "$table":
            return self.spark.read.schema(T.StructType.fromJson(value["schema"])).parquet(f"{self.folder}/{inner}")
        if kind == "$model":
            return self._class(value["class"], "pyspark.ml").load(f"{self.folder}/{inner}")
        if kind == "$part":
            target = self._class(inner, _PACKAGE)
            if set(value["fields"]) != set(_FIELDS.get(target, ())):
                raise ValueError(f"{inner} was stored with fields {sorted(value['fields'])}; this version has {sorted(_FIELDS.get(target, ()))}")
            return target(**{f: self.decode(v) for f, v in value["fields"].items()})
        raise ValueError(f"unknown value {kind!r} in the manifest")


# --- versions --------------------------------------------------------------------


def save_plan(spark: SparkSession, plan: object, root: str, name: str, notes: dict | None = None) -> int:
    """Store a fitted object as the next version of ``name``; returns the version's number.

    Nothing is visible to readers before everything is written.
    """
    home = f"{root.rstrip('/')}/{name}"
    folder = f"{home}/data-{uuid.uuid4().hex}"
    tree = _Writer(spark, folder).encode(plan)
    saved_at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="seconds")
    manifest = {"format": FORMAT, "kind": type(plan).__name__, "saved_at": saved_at, "notes": notes or {}, "plan": tree}
    _create(spark, f"{folder}/manifest.json", json.dumps(manifest))
    number = max(_numbers(spark, home), default=0) + 1
    while not _create(spark, f"{home}/_versions/v{number:08d}", folder.rsplit("/", 1)[1]):
        number += 1
    return number


def _numbers(spark: SparkSession, home: str) -> list[int]:
    return [int(n[1:]) for n in _names(spark, f"{home}/_versions") if n.startswith("v") and n[1:].isdigit()]


def _manifest(spark: SparkSession, home: str, version: int) -> tuple[str, dict]:
    folder = f"{home}/{_read(spark, f'{home}/_versions/v{version:08d}').strip()}"
    manifest = json.loads(_read(spark, f"{folder}/manifest.json"))
    if manifest["format"] != FORMAT:
        raise ValueError(f"version {version} has format {manifest['format']}; this code reads {FORMAT}")
    return folder, manifest


def load_plan(spark: SparkSession, root: str, name: str, version: int | None = None):
    """The stored object, the newest version unless one is named. Tables are read when they are used."""
    home = f"{root.rstrip('/')}/{name}"
    numbers = _numbers(spark, home)
    if not numbers or (version is not None and version not in numbers):
        raise FileNotFoundError(f"no stored plan {name!r}" + ("" if version is None else f" of version {version}"))
    folder, manifest = _manifest(spark, home, max(numbers) if version is None else version)
    return _Reader(spark, folder).decode(manifest["plan"])


def plan_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(version, kind, saved_at, folder, notes) of every stored version."""
    home = f"{root.rstrip('/')}/{name}"
    rows = []
    for number in _numbers(spark, home):
        folder, manifest = _manifest(spark, home, number)
        rows.append((number, manifest["kind"], manifest["saved_at"], folder, json.dumps(manifest["notes"], sort_keys=True)))
    return small_frame(spark, rows, "version int, kind string, saved_at string, folder string, notes string")


def list_plans(spark: SparkSession, root: str) -> list[str]:
    """Names that have a stored version, in order."""
    return [n for n in _names(spark, root) if _numbers(spark, f"{root.rstrip('/')}/{n}")]


def delete_plans(spark: SparkSession, root: str, name: str, keep: int = 0) -> list[int]:
    """Remove all but the newest ``keep`` versions and what broken saves left; returns their numbers.

    The marker goes first, so that no reader starts on a version that is being removed.
    """
    home = f"{root.rstrip('/')}/{name}"
    numbers = sorted(_numbers(spark, home))
    old = numbers[:len(numbers) - keep] if keep else numbers
    for number in old:
        fs, where = _file(spark, f"{home}/_versions/v{number:08d}")
        fs.delete(where, False)
    kept = {_read(spark, f"{home}/_versions/v{n:08d}").strip() for n in _numbers(spark, home)}
    for folder in _names(spark, home):
        if folder.startswith("data-") and folder not in kept:
            fs, where = _file(spark, f"{home}/{folder}")
            fs.delete(where, True)
    return old
