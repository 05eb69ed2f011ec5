"""Landing files from the network: elevation tiles that rasters.terrain reads.

Each distinct file is one row of work. A task fetches its files one after the other, writes each beside its place and renames it when it is whole, so a file that is there is
complete; what is there already isn't fetched again, and a task that is tried again, or runs twice, does no harm. What can't be fetched is a row with its error; nothing is
dropped in silence.
"""

from __future__ import annotations

import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rasters import uri

#: Files at a time for one task; attempts for one file, and seconds before the second, doubled for each one after.
FILES, ATTEMPTS, WAIT = 4, 3, 1.0
CHUNK = 1 << 20
SCHEMA = "url string, path string, status string, bytes long, error string"


def fetch(url: str, path: str, *, timeout: float, attempts: int, wait: float) -> tuple[str, int | None, str | None]:
    """status (there, fetched, missing, failed), bytes, error. Missing: the server says that there is no such file, which isn't asked again."""
    import urllib.error
    import urllib.request

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(uri(path))
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return "there", info.size, None
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    error = None
    for k in range(attempts):
        if k:
            time.sleep(wait * 2 ** (k - 1))
        part = f"{at}.part-{uuid.uuid4().hex}"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as got:
                told, n = got.headers.get("Content-Length"), 0
                with system.open_output_stream(part) as out:
                    while data := got.read(CHUNK):
                        out.write(data)
                        n += len(data)
            if told is not None and n != int(told):
                raise OSError(f"{n} bytes of {told}")
            system.move(part, at)
            return "fetched", n, None
        except urllib.error.HTTPError as e:
            error = f"HTTP {e.code}"
            if e.code in (404, 410):
                return "missing", None, error
        except Exception as e:  # whatever the network or the store did is the file's result
            error = f"{type(e).__name__}: {e}"
        finally:
            if system.get_file_info(part).type == fs.FileType.File:
                system.delete_file(part)
    return "failed", None, error


def land(files: DataFrame, folder: str, *, timeout: float = 60.0, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """files: url, name (of the file in the folder). url, path, status, bytes, error: a row for each distinct file.

    The plan acts when it runs; write its result once (a job's record) and read that, as each run looks at the folder anew."""
    spark = files.sparkSession
    own = files.select("url", "name").filter("url is not null and name is not null").distinct()
    many = own.count()  # files, not pixels
    base = folder.rstrip("/")

    def run(batches):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for url, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = f"{base}/{name}"
                row = (url, path, *fetch(url, path, timeout=timeout, attempts=attempts, wait=wait))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    tasks = max(1, min(many, max(2 * spark.sparkContext.defaultParallelism, many // FILES)))
    return own.repartition(tasks, "name").mapInArrow(run, SCHEMA)


def elevation(cells: DataFrame, folder: str, base_url: str, **how) -> DataFrame:
    """cells: dem (names that terrain.dem_cells gives, for any number of tiles). Each distinct one is landed as dem.tif from base_url/dem/dem.tif."""
    named = cells.select("dem").distinct()
    base = base_url.rstrip("/")
    return land(named.select(F.concat(F.lit(f"{base}/"), "dem", F.lit("/"), "dem", F.lit(".tif")).alias("url"), F.concat("dem", F.lit(".tif")).alias("name")), folder, **how)
