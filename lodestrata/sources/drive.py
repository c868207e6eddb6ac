"""A cloud drive folder as a Spark data source: list, download or export in the tasks, then the file readers.

A client is anything with the drive API's ``files().list / get_media / export_media``; tests pass one of their own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.records import TYPES, record_id
from ..session import ship_package
from .files import connector, ingest

SCOPES = ("https://www.googleapis.com/auth/drive.readonly",)
FOLDER = "application/vnd.google-apps.folder"
NATIVE = "application/vnd.google-apps"
_OFFICE = "application/vnd.openxmlformats-officedocument."
# What native documents are exported as.
EXPORTS = {
    f"{NATIVE}.spreadsheet": (f"{_OFFICE}spreadsheetml.sheet", ".xlsx"),
    f"{NATIVE}.document": (f"{_OFFICE}wordprocessingml.document", ".docx"),
    f"{NATIVE}.presentation": (f"{_OFFICE}presentationml.presentation", ".pptx"),
}
CREDENTIALS = ("LODESTRATA_GDRIVE_CREDENTIALS", "GOOGLE_APPLICATION_CREDENTIALS")
FILE_FIELDS = "nextPageToken, files(id, name, mimeType, modifiedTime)"
PAGE = 100
#: Files that one task downloads.
SHARE = 16
#: Stands between an id and a name.
MARK = "\u241f"


def credentials(path: str | None = None) -> str:
    """The key file: the argument, else the first environment variable that is set."""
    found = path or next((v for k in CREDENTIALS if (v := os.environ.get(k))), None)
    if not found or not Path(found).exists():
        raise FileNotFoundError(f"no service account key; set {CREDENTIALS[0]} to its path")
    return found


def connection(path: str | None = None) -> Callable[[], object]:
    """A function that makes a read-only drive client, wherever it is called: the key goes with it, not the key's path.
    Missing libraries raise here already: a pull that was asked for must not be skipped silently."""
    key = json.loads(Path(credentials(path)).read_text())
    for module in ("google.oauth2.service_account", "googleapiclient.discovery"):
        try:
            import_module(module)
        except ImportError as e:
            raise ImportError("drive folders need google-api-python-client and google-auth") from e

    def connect():
        from google.oauth2.service_account import Credentials
        from googleapiclient.discovery import build

        return build("drive", "v3", credentials=Credentials.from_service_account_info(key, scopes=list(SCOPES)), cache_discovery=False)

    return connect


def children(service, folder: str) -> Iterator[dict]:
    """What a folder holds itself, trashed items left out, page by page."""
    ask = {"q": f"'{folder}' in parents and trashed=false", "fields": FILE_FIELDS, "pageSize": PAGE, "supportsAllDrives": True, "includeItemsFromAllDrives": True}
    following: str | None = ""
    while following is not None:
        answer = service.files().list(**ask, pageToken=following or None).execute()
        yield from answer.get("files", ())
        following = answer.get("nextPageToken") or None


def below(service, folder: str, recursive: bool = True) -> Iterator[dict]:
    """Files in a folder and, where recursive, in the folders below it, each folder once. Native kinds that have no
    export are left out."""
    waiting, known = [folder], {folder}
    while waiting:
        for item in children(service, waiting.pop()):
            kind = item["mimeType"]
            if kind == FOLDER:
                if recursive and item["id"] not in known:
                    known.add(item["id"])
                    waiting.append(item["id"])
            elif kind in EXPORTS or not kind.startswith(NATIVE):
                yield item


def named(item: dict) -> str:
    """The name that decides the reader: a native document's with its export's extension."""
    ending = EXPORTS.get(item["mimeType"], ("", ""))[1]
    return item["name"] if item["name"].lower().endswith(ending) else item["name"] + ending


def content_of(service, item: dict) -> bytes:
    """A file's bytes; of a native document those of its export."""
    export = EXPORTS.get(item["mimeType"])
    request = service.files().export_media(fileId=item["id"], mimeType=export[0]) if export else service.files().get_media(fileId=item["id"], supportsAllDrives=True)
    return request.execute()


@dataclass
class Share(InputPartition):
    """The files that one task downloads."""

    items: list[dict]


class FolderReader(DataSourceReader):
    """Lists a folder once, when the scan is planned; each task then makes its own client and downloads its files."""

    def __init__(self, connect: Callable[[], object], folder: str, recursive: bool, share: int):
        self.connect, self.folder, self.recursive, self.share = connect, folder, recursive, share

    def partitions(self) -> list[Share]:
        items = list(below(self.connect(), self.folder, self.recursive))
        return [Share(items[k : k + self.share]) for k in range(0, len(items), self.share)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        if partition.items:
            service = self.connect()
            for item in partition.items:
                yield f"drive:{item['id']}/{named(item)}", named(item), content_of(service, item), item["id"], item["name"], item.get("modifiedTime")


def folder_source(connect: Callable[[], object], folder: str, recursive: bool = True, share: int = SHARE) -> type[DataSource]:
    """A data source over one drive folder: register it, then read its format ``drive_folder``."""

    class DriveFolder(DataSource):
        @classmethod
        def name(cls) -> str:
            return "drive_folder"

        def schema(self) -> str:
            return "path string, name string, content binary, origin_id string, origin_name string, origin_modified string"

        def reader(self, schema) -> FolderReader:
            return FolderReader(connect, folder, recursive, share)

    return DriveFolder


class ChangesReader(DataSourceStreamReader):
    """A folder as a stream. Its offset is the drive's change token: the first batch holds the whole folder, each later
    one the files that changed since, and those that were removed. A file that changes while a batch is read may come
    once more in the next one."""

    def __init__(self, connect: Callable[[], object], folder: str, recursive: bool, share: int):
        self.connect, self.folder, self.recursive, self.share = connect, folder, recursive, share

    def initialOffset(self) -> dict:
        return {"token": ""}

    def latestOffset(self) -> dict:
        return {"token": str(self.connect().changes().getStartPageToken(supportsAllDrives=True).execute()["startPageToken"])}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        service = self.connect()
        found = list(changed(service, self.folder, start["token"], self.recursive) if start["token"] else below(service, self.folder, self.recursive))
        return [Share(found[k : k + self.share]) for k in range(0, len(found), self.share)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        service = self.connect() if partition.items else None
        for item in partition.items:
            if item.get("removed"):
                yield None, None, None, item["id"], None, None, True
            else:
                yield f"drive:{item['id']}/{named(item)}", named(item), content_of(service, item), item["id"], item["name"], item.get("modifiedTime"), False


def changed(service, folder: str, token: str, recursive: bool = True) -> Iterator[dict]:
    """The last state of each file that changed since the token: its listing, or its id and ``removed``. A file that is
    trashed, or has left the folder, is removed."""
    ask = {"fields": "nextPageToken,newStartPageToken,changes(fileId,removed,file(id,name,mimeType,modifiedTime,trashed,parents))", "pageSize": PAGE, "includeRemoved": True, "supportsAllDrives": True, "includeItemsFromAllDrives": True}
    last, following = {}, token
    while following:
        answer = service.changes().list(pageToken=following, **ask).execute()
        last |= {c["fileId"]: c for c in answer.get("changes", ())}
        following = answer.get("nextPageToken")
    above: dict[str, bool] = {folder: True}

    def inside(parents: list[str]) -> bool:
        """One of the parents is the folder or, where recursive, lies in it; parents of folders are asked for once."""
        for p in parents:
            if p not in above and recursive:
                above[p] = False  # a circle leads nowhere
                above[p] = inside(service.files().get(fileId=p, fields="parents", supportsAllDrives=True).execute().get("parents", []))
        return any(above.get(p) for p in parents)

    for number, change in last.items():
        item = change.get("file") or {}
        kind = item.get("mimeType", "")
        if change.get("removed") or item.get("trashed") or not inside(item.get("parents", [])):
            yield {"id": number, "removed": True}
        elif kind in EXPORTS or not kind.startswith(NATIVE):
            yield item


def drive_stream(spark: SparkSession, connect: Callable[[], object], folder: str, recursive: bool = True, share: int = SHARE) -> DataFrame:
    """drive_files() as a stream of changes, with a column ``removed``; rows of removed files hold their origin_id only."""

    class DriveChanges(DataSource):
        @classmethod
        def name(cls) -> str:
            return "drive_changes"

        def schema(self) -> str:
            return "path string, name string, content binary, origin_id string, origin_name string, origin_modified string, removed boolean"

        def streamReader(self, schema) -> ChangesReader:
            return ChangesReader(connect, folder, recursive, share)

    ship_package(spark)
    spark.dataSource.register(DriveChanges)
    return spark.readStream.format("drive_changes").load()


def drive_files(spark: SparkSession, connect: Callable[[], object], folder: str, recursive: bool = True, share: int = SHARE) -> DataFrame:
    """(path, name, content, origin_id, origin_name, origin_modified) of a drive folder's files. connect makes a client;
    only the listing is made in one place, contents go from the drive to the task that reads them. A lost task downloads
    its files again."""
    ship_package(spark)
    spark.dataSource.register(folder_source(connect, folder, recursive, share))
    return spark.read.format("drive_folder").load()


def ingest_drive(files: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Records whose source_file is the drive's own name, with id and time of the origin and the id made anew.

    The readers see each file under its own name with its id before it, in one pass over all files; the id is cut off
    again after that, so two files of one name stay apart.
    """
    listed = files.select("origin_id", "origin_name", "origin_modified", "name").distinct()
    kinds = {r[0] for r in listed.select(connector(F.col("name"))).distinct().collect()}
    found = None
    for kind in sorted(kinds):  # a scan is told by how its own name begins, so formats are dealt before names change
        part = files.where(connector(F.col("name")) == kind)
        tagged = part.withColumn("name", F.concat(F.lit("scan" if kind == "scan" else ""), "origin_id", F.lit(MARK), "name"))
        rows = ingest(tagged, strict_compat, {kind})
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return files.sparkSession.createDataFrame([], ", ".join(f"{c} {k}" for c, k in TYPES.items()))
    prefix = f"^(scan)?[^{MARK}]*{MARK}"
    clean = {c: F.regexp_replace(c, prefix, "") for c in ("title", "sheet")}
    rows = found.withColumn("_origin", F.regexp_extract("source_file", rf"^(?:scan)?([^{MARK}]*){MARK}", 1)).withColumns(clean)
    raw = F.when(F.col("raw_text").startswith(F.col("_origin")), F.regexp_replace("raw_text", prefix, "")).otherwise(F.col("raw_text"))
    rows = rows.withColumn("raw_text", raw).join(listed.select(F.col("origin_id").alias("_origin"), "origin_name", "origin_modified"), "_origin")
    extra = F.struct(*(F.col(f"extra.{c}").alias(c) for c in ("columns", "ocr_engine", "extractor", "has_notes")), F.col("_origin").alias("origin_id"), "origin_modified")
    rows = rows.withColumns({"source_file": F.col("origin_name"), "extra": extra})
    return rows.withColumn("id", record_id(F.col("source_file"), F.col("sheet"), F.col("row_or_page"), F.col("title"))).select(*TYPES)
