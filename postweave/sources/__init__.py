from postweave.sources.buckets import open_bucketed, write_bucketed
from postweave.sources.checkpoints import load_checkpoint, save_checkpoint
from postweave.sources.manifest import LOAD_ORDER, read_manifest
from postweave.sources.media import scan_media, write_media
from postweave.sources.tables import read_table, write_manifest_csv, write_tables

__all__ = [
    "LOAD_ORDER",
    "load_checkpoint",
    "open_bucketed",
    "read_manifest",
    "read_table",
    "save_checkpoint",
    "scan_media",
    "write_bucketed",
    "write_manifest_csv",
    "write_media",
    "write_tables",
]
