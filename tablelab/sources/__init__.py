"""Readers and writers. Every reader returns a plain DataFrame; folder layouts add ``split``."""

from .archives import expand_archives
from .excel import excel_rows, read_excel
from .folders import SPLIT_FOLDERS, check_split_folders, read_labelled_files, split_of
from .legacy import read_legacy_xy
from .storage import history, ingest, load_dataset, read_manifest, resplit_saved, save_dataset, update_saved_spec
from .text_formats import read_csv, read_json, read_json_lines

__all__ = [
    "SPLIT_FOLDERS",
    "check_split_folders",
    "excel_rows",
    "expand_archives",
    "history",
    "ingest",
    "load_dataset",
    "read_csv",
    "read_excel",
    "read_json",
    "read_json_lines",
    "read_labelled_files",
    "read_legacy_xy",
    "read_manifest",
    "resplit_saved",
    "save_dataset",
    "update_saved_spec",
    "split_of",
]
