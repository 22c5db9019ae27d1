"""Archives: every figure file, or one answer with its pages, figures and photos."""
from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame


def zip_files(files: DataFrame, root: str, target: str, text: str | None = None) -> int:
    """Write a deflated archive of ``files(filename[, arcname])`` in the order given.

    Names stream to the driver one partition at a time; missing files and names that
    leave ``root`` are skipped.  Returns the number of files written.
    """
    base, written = os.path.realpath(root), 0
    columns = ["filename", "arcname"] if "arcname" in files.columns else ["filename"]
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        if text is not None:
            archive.writestr("answer.txt", text)
        for row in files.select(*columns).toLocalIterator():
            path = os.path.realpath(os.path.join(base, row[0]))
            if os.path.commonpath([base, path]) == base and os.path.isfile(path):
                archive.write(path, row[-1])
                written += 1
    return written


def accept_upload(name: str, content: bytes, folder: str) -> str:
    """Store an uploaded PDF under its bare file name."""
    bare = os.path.basename(name.replace("\\", "/"))
    if not bare.lower().endswith(".pdf"):
        raise ValueError("only PDF files are accepted")
    if not content:
        raise ValueError("the file is empty")
    path = os.path.join(folder, bare)
    with open(path, "wb") as out:
        out.write(content)
    return path
