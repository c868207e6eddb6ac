"""A drive folder followed by its change tokens; the drive is a file on disk, since readers run in processes of their own."""

import functools
import json
import sys

from pyspark import cloudpickle

from lodestrata.plans import engine
from lodestrata.sources import drive


class Answer:
    def __init__(self, value):
        self.value = value

    def execute(self):
        return self.value


class DiskDrive:
    """Answers as the drive client does; a change's number is its token."""

    def __init__(self, path):
        self.path = path
        with open(path) as f:
            self.state = json.load(f)

    def files(self):
        return Files(self)

    def changes(self):
        return Changes(self)


class Files:
    def __init__(self, owner):
        self.owner, self.state = owner, owner.state

    def list(self, q, **_):
        parent = q.split("'")[1]
        return Answer({"files": [{"id": i, **f} for i, f in self.state["files"].items() if parent in f["parents"]]})

    def get(self, fileId, **_):
        return Answer({"parents": self.state["files"].get(fileId, {}).get("parents", [])})

    def get_media(self, fileId, **_):
        with open(f"{self.owner.path}.log", "a") as f:
            f.write(fileId + "\n")
        return Answer(self.state["content"][fileId].encode())


class Changes:
    def __init__(self, owner):
        self.state = owner.state

    def getStartPageToken(self, **_):
        return Answer({"startPageToken": str(len(self.state["log"]) + 1)})

    def list(self, pageToken, **_):
        start = int(pageToken) - 1
        page = self.state["log"][start : start + 2]  # pages of two
        rows = [{"fileId": i, "removed": i not in self.state["files"], "file": {"id": i, **self.state["files"].get(i, {})}} for i in page]
        more = start + 2 < len(self.state["log"])
        return Answer({"changes": rows, **({"nextPageToken": str(start + 3)} if more else {"newStartPageToken": str(len(self.state["log"]) + 1)})})


def test_changes_are_followed(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    path, root = str(tmp_path / "drive.json"), str(tmp_path / "index")
    state = {"files": {}, "content": {}, "log": []}

    def put(number, name, text, parents=("root",), kind="text/markdown"):
        state["files"][number] = {"name": name, "mimeType": kind, "modifiedTime": "t", "parents": list(parents)}
        state["content"][number] = text
        state["log"].append(number)

    def sync():
        with open(path, "w") as f:
            json.dump(state, f)
        open(f"{path}.log", "w").close()
        engine.follow_drive(spark, root, functools.partial(DiskDrive, path), "root", str(tmp_path / "checkpoint")).awaitTermination()
        with open(f"{path}.log") as f:
            read = sorted(set(f.read().split()))
        return read, sorted(r["raw_text"] for r in engine.open_index(spark, root).table("records").collect())

    put("sub", "sub", "", kind=drive.FOLDER)
    put("elsewhere", "other", "", ("top",), drive.FOLDER)
    put("1", "a.md", "# A\nalpha")
    put("2", "b.md", "# B\nbeta", ("sub",))
    put("3", "c.md", "# C\ngamma", ("elsewhere",))
    assert sync() == (["1", "2"], ["A\nalpha", "B\nbeta"])
    put("2", "b.md", "# B\nbeta two", ("sub",))
    put("4", "a.md", "# D\ndelta", ("sub",))
    put("5", "e.md", "# E\nepsilon", ("elsewhere",))
    assert sync() == (["2", "4"], ["A\nalpha", "B\nbeta two", "D\ndelta"])
    del state["files"]["1"]
    state["log"].append("1")
    put("4", "a.md", "# D\ndelta", ("elsewhere",))  # moved out of the folder
    assert sync() == ([], ["B\nbeta two"])
    assert sync() == ([], ["B\nbeta two"])
