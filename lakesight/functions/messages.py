"""Body text and visibility of chat messages made of mixed parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lakesight.functions.text import strip

IMAGE = "image_asset_pointer"
CONTEXT = "model_editable_context"


def is_visible(role: Column, hidden: Column | None = None) -> Column:
    visible = ~role.eqNullSafe(F.lit("system"))
    return visible if hidden is None else visible & ~F.coalesce(hidden, F.lit(False))


def body_text(content_type: Column, context: Column, parts: Column, attachments: Column) -> Column:
    """Text of one message: strings as they are, images by attachment name, objects by their text.

    ``parts`` is ``array<struct<kind,text>>`` with kinds ``string``, ``object``
    and the image pointer; ``attachments`` is ``array<struct<name>>`` in image order.
    """
    images_before = lambda i: F.size(
        F.filter(F.slice(parts, F.lit(1), i), lambda p: p["kind"] == IMAGE)
    )

    def chunk(part: Column, i: Column) -> Column:
        name = F.get(attachments, images_before(i))["name"]
        image = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("[image: "), name, F.lit("]"))).otherwise(
            "[image]"
        )
        return (
            F.when(part["kind"] == IMAGE, image)
            .when(part["kind"] == "string", F.when(strip(part["text"]) != "", part["text"]))
            .otherwise(F.nullif(strip(part["text"]), F.lit("")))
        )

    chunks = F.array_compact(F.transform(parts, chunk))
    text = F.nullif(strip(F.array_join(chunks, "\n")), F.lit(""))
    return F.when(content_type == CONTEXT, F.nullif(strip(context), F.lit(""))).otherwise(text)


def message_block(role: Column, text: Column, markdown: bool = False) -> Column:
    """One message as it stands in a transcript."""
    if markdown:
        return F.concat(F.lit("\n### "), role, F.lit("\n\n"), text, F.lit("\n"))
    return F.concat(F.lit("\n----- MESSAGE (role="), role, F.lit(") -----\n"), text, F.lit("\n"))
