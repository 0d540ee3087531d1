"""Where a run's files are, read from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Paths of the dump, its index, and everything that is built from them."""

    dump: str
    index: str
    page_indices: str = "indices"
    template_indices: str = "template_indices"
    templates: str = "templates.xml"
    anchors: str = "anchors.tsv"
    anchor_counts: str = "anchor_counts.tsv"
    search_index: str = "search-index"

    @staticmethod
    def load(path: str) -> Settings:
        """Settings of a TOML file: [data] dump and index are required, the rest has defaults.

        Tables are [indices] pages and templates, [anchors] anchors and anchor_counts, [search_index]
        index_dir, and templates at the top. The older names indices and template_indices are taken too.
        """
        with open(path, "rb") as file:
            tree = tomllib.load(file)
        data, indices, anchors = tree.get("data", {}), tree.get("indices", {}), tree.get("anchors", {})
        for name in ("dump", "index"):
            if not data.get(name):
                raise ValueError(f"settings lack data.{name}")
        found = {
            "page_indices": indices.get("pages", indices.get("indices")),
            "template_indices": indices.get("templates", indices.get("template_indices")),
            "templates": tree.get("templates"),
            "anchors": anchors.get("anchors"),
            "anchor_counts": anchors.get("anchor_counts"),
            "search_index": tree.get("search_index", {}).get("index_dir"),
        }
        return Settings(data["dump"], data["index"], **{k: v for k, v in found.items() if v})
