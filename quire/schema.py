"""Tables and elements as Spark schemas, and how loose element rows become canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DOCUMENTS = "id string, filename string, file_type string, total_pages int, created_at timestamp, updated_at timestamp"
PAGES = "id string, document_id string, page_number int, markdown_content string, image binary, image_width int, image_height int, created_at timestamp"
ELEMENTS = "id string, page_id string, label string, text_content string, x1 int, y1 int, x2 int, y2 int, norm_x1 double, norm_y1 double, norm_x2 double, norm_y2 double, sequence_order int"
TREES = "id string, document_id string, tree_data string, config map<string,string>, created_at timestamp"
NODES = "id string, tree_index_id string, node_id string, node_type string, title string, summary string, parent_node_id string, page_start int, page_end int, token_count int"

#: Other names under which element rows bring a column, and what stands for a missing value.
_NAMES = {
    "document_id": ((), "''"), "page_number": (("page",), "1"), "seq": (("sequence_order", "idx"), "0"), "label": ((), "'text'"), "text_content": (("text",), "''"),
    "x1": (("bbox_x1",), "0"), "y1": (("bbox_y1",), "0"), "x2": (("bbox_x2",), "0"), "y2": (("bbox_y2",), "0"),
}
CANONICAL = tuple(_NAMES)


def normalise(elements: DataFrame) -> DataFrame:
    """Canonical columns first, by whichever name they came; the others follow."""
    have = set(elements.columns)
    out = []
    for name, (others, default) in _NAMES.items():
        given = [F.col(c) for c in (name, *others) if c in have]
        out.append(F.coalesce(*given, F.expr(default)).alias(name))
    used = {c for name, (others, _) in _NAMES.items() for c in (name, *others)}
    return elements.select(*out, *[c for c in elements.columns if c not in used])
