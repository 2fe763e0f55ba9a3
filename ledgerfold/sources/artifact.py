"""Verified exports of a fold: a folder of Parquet and a manifest of digests, made and installed whole or not at all."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ledgerfold.errors import ArtifactInvalid
from ledgerfold.files import Files
from ledgerfold.kernels import cursor_hex, parse_cursor_hex
from ledgerfold.operators.fold import bucket_of
from ledgerfold.sources.schema import ARTIFACT_SCHEMA
from ledgerfold.sources.store import FORMAT_GENERATION, STORED, FoldReader, FoldStore

MANIFEST, DATA, BACKEND = "MANIFEST.json", "data", "ledgerfold-parquet"


@dataclass(frozen=True)
class Manifest:
    schema_version: int
    backend: str
    backend_version: str
    cursor_hex: str
    created_at_unix: int
    files: tuple[dict, ...]
    hash_alg: str = "sha256"

    @property
    def cursor(self) -> int | None:
        return parse_cursor_hex(self.cursor_hex)

    def dump(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @staticmethod
    def parse(raw: bytes) -> Manifest:
        """Strict: unknown or missing fields, other schemas and paths outside the payload are refused."""
        try:
            d = json.loads(raw)
            if not isinstance(d, dict) or set(d) != set(Manifest.__dataclass_fields__):
                raise ArtifactInvalid("manifest fields are not those of the schema")
            if d["schema_version"] != ARTIFACT_SCHEMA or d["hash_alg"] != "sha256":
                raise ArtifactInvalid(f"manifest schema {d['schema_version']} is not supported")
            for f in d["files"]:
                parts = f["path"].split("/")
                if set(f) != {"path", "size", "digest"} or parts[0] != DATA or len(parts) < 2 or {"", ".", ".."} & set(parts) or "\\" in f["path"]:
                    raise ArtifactInvalid(f"manifest names {f.get('path')!r}")
            parse_cursor_hex(d["cursor_hex"])
            return Manifest(**d | {"files": tuple(d["files"])})
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ArtifactInvalid(f"manifest: {e}") from e


def payload(files: Files, folder: str) -> list[str]:
    """Paths below data/, sorted. Anything but plain files is refused."""
    if odd := files.odd(f"{folder}/{DATA}"):
        raise ArtifactInvalid(f"{odd} is not a plain file")
    return [f"{DATA}/{n}" for n in files.walk(f"{folder}/{DATA}")]


def digests(spark: SparkSession, folder: str) -> dict[str, tuple[int, str]]:
    """Size and SHA-256 of each payload file, hashed by the executors; the driver gets the digests."""
    at = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{at}/{DATA}")
    top = at.partition("://")[2].rstrip("/") + "/"
    return {r["path"][r["path"].rindex(top) + len(top) :]: (r["length"], r["digest"]) for r in found.select("path", "length", F.sha2("content", 256).alias("digest")).collect()}


def check_free(files: Files, dest: str) -> None:
    if not files.free(dest):
        raise ArtifactInvalid(f"{dest} is not empty; nothing is overwritten")


def _install(files: Files, staged: str, dest: str) -> None:
    check_free(files, dest)
    files.rename(staged, dest)


def _beside(dest: str) -> str:
    parent, _, name = dest.rstrip("/").rpartition("/")
    return f"{parent}/.{name}.{uuid.uuid4().hex}"


def export(store: FoldReader, dest: str, clock=time.time) -> Manifest:
    """Write the fold and its cursor to dest, on any file system Spark writes to.

    The payload is read back and hashed by the executors before the manifest
    goes last; then all is renamed into place.
    """
    spark, files, staged = store.spark, Files(store.spark), _beside(dest)
    check_free(files, dest)
    try:
        buckets = store.manifest["buckets"] if store.manifest else 1
        rows = store.rows().withColumn("bucket", bucket_of(F.col("key"), buckets))
        rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{staged}/{DATA}/fold")
        for name in files.walk(f"{staged}/{DATA}"):
            if name.rpartition("/")[2][0] in "._":
                files.remove(f"{staged}/{DATA}/{name}")
        files.create(f"{staged}/{DATA}/meta.json", json.dumps({"cursor_hex": cursor_hex(store.cursor), "buckets": buckets}).encode())
        made = digests(spark, staged)
        if set(made) != set(payload(files, staged)):
            raise ArtifactInvalid("the payload changed while it was hashed")
        manifest = Manifest(ARTIFACT_SCHEMA, BACKEND, FORMAT_GENERATION, cursor_hex(store.cursor), int(clock()), tuple({"path": p, "size": made[p][0], "digest": made[p][1]} for p in sorted(made)))
        files.create(f"{staged}/{MANIFEST}", manifest.dump())
        _install(files, staged, dest)
        return manifest
    finally:
        files.remove(staged)


def read_manifest(files: Files, folder: str) -> Manifest:
    if not files.exists(f"{folder}/{MANIFEST}"):
        raise ArtifactInvalid("no manifest")
    return Manifest.parse(files.read(f"{folder}/{MANIFEST}"))


def same_generation(version: str) -> None:
    """The default rule on the format an artifact was made with: exactly ours."""
    if version != FORMAT_GENERATION:
        raise ArtifactInvalid(f"generation {version} is not {FORMAT_GENERATION}")


def verify(folder: str, check_version: Callable[[str], None] = same_generation, spark: SparkSession | None = None) -> Manifest:
    """All checks on an artifact: manifest, backend, generation (by check_version), no extras, sizes, digests, cursor."""
    spark = spark or SparkSession.builder.getOrCreate()
    files = Files(spark)
    m = read_manifest(files, folder)
    if m.backend != BACKEND:
        raise ArtifactInvalid(f"made by {m.backend}")
    check_version(m.backend_version)
    there, named = set(payload(files, folder)), {f["path"] for f in m.files}
    if extra := there - named:
        raise ArtifactInvalid(f"not in the manifest: {sorted(extra)[0]}")
    if missing := named - there:
        raise ArtifactInvalid(f"missing: {sorted(missing)[0]}")
    _match(m, digests(spark, folder))
    meta = json.loads(files.read(f"{folder}/{DATA}/meta.json"))
    if meta["cursor_hex"] != m.cursor_hex:
        raise ArtifactInvalid("the payload's cursor is not the manifest's")
    return m


def _match(m: Manifest, found: dict[str, tuple[int, str]]) -> None:
    for f in m.files:
        if found.get(f["path"]) != (f["size"], f["digest"]):
            raise ArtifactInvalid(f"{f['path']} doesn't match its digest")


def import_(spark: SparkSession, folder: str, dest: str, check_version: Callable[[str], None] = same_generation) -> FoldStore:
    """Install a verified artifact as a fold at dest, which must be absent or empty.

    The executors read the payload into the fold's own files; it is hashed
    again afterwards, so what was read is what was verified.
    """
    files, staged = Files(spark), _beside(dest)
    m = verify(folder, check_version, spark)
    check_free(files, dest)
    try:
        meta = json.loads(files.read(f"{folder}/{DATA}/meta.json"))
        to, base = f"base/{1:020d}", {}
        if any(f["path"].startswith(f"{DATA}/fold/bucket=") for f in m.files):
            rows = spark.read.schema(STORED).parquet(f"{folder}/{DATA}/fold")
            rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(f"{staged}/{to}")
            base = {n.partition("=")[2]: f"{to}/{n}" for n in files.names(f"{staged}/{to}") if n.startswith("bucket=")}
        _match(m, digests(spark, folder))
        files.create(f"{staged}/manifests/{1:020d}", json.dumps({"n": 1, "base": base, "deltas": [], "cursor_hex": m.cursor_hex, "buckets": meta["buckets"], "generation": FORMAT_GENERATION, "written_unix": m.created_at_unix}).encode())
        if FoldStore(spark, staged).cursor != m.cursor:
            raise ArtifactInvalid("the installed cursor is not the manifest's")
        _install(files, staged, dest)
        return FoldStore(spark, dest)
    finally:
        files.remove(staged)
