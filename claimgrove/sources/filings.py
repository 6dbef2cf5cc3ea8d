"""Filing markup to text nodes, one streaming pass per document inside a Spark job."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

NODE = "position int, element_path string, row_group int, text string, char_start int, char_end int"


def filing_text_nodes(
    pages: DataFrame, ids: Sequence[str], html: str = "html", skip: Sequence[str] = ("script", "style")
) -> DataFrame:
    """Text nodes in reading order with element path, row group and offsets.

    Offsets index the projection that joins the nodes with newlines. Nodes of
    one table row share `row_group`, rows bound by a row span share it too.
    Documents stream through the task; none is gathered with others.
    """
    ids = list(ids)
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in ids] + [NODE])
    skipped = frozenset(skip)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html.parser import HTMLParser

        void = frozenset("area base br col embed hr img input link meta source track wbr".split())

        class Nodes(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack = []  # (name, path, child counts)
                self.root_counts = {}
                self.rows, self.group, self.open_rows, self.held = [], 0, [], 0

            def handle_starttag(self, tag, attrs):
                counts = self.stack[-1][2] if self.stack else self.root_counts
                counts[tag] = counts.get(tag, 0) + 1
                base = self.stack[-1][1] if self.stack else ""
                if tag in void:
                    return
                self.stack.append((tag, f"{base}/{tag}[{counts[tag]}]", {}))
                if tag == "tr":
                    if self.held > 0:
                        self.held -= 1
                    else:
                        self.group += 1
                    self.open_rows.append(self.group)
                elif tag in ("td", "th") and self.open_rows:
                    span = dict(attrs).get("rowspan") or "1"
                    if span.isascii() and span.isdigit():
                        self.held = max(self.held, int(span) - 1)

            def handle_endtag(self, tag):
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == tag:
                        for name, _, _ in self.stack[i:]:
                            if name == "tr" and self.open_rows:
                                self.open_rows.pop()
                            elif name == "table":
                                self.held = 0
                        del self.stack[i:]
                        return

            def handle_data(self, data):
                value = " ".join(data.split())
                if value and not any(name in skipped for name, _, _ in self.stack):
                    path = self.stack[-1][1] if self.stack else "/"
                    self.rows.append((path, self.open_rows[-1] if self.open_rows else None, value))

        columns = [*ids, "position", "element_path", "row_group", "text", "char_start", "char_end"]
        for batch in batches:
            out = []
            for row in batch[[*ids, html]].itertuples(index=False, name=None):
                if row[-1] is None:
                    continue
                parser = Nodes()
                parser.feed(row[-1])
                parser.close()
                cursor = 0
                for position, (path, group, value) in enumerate(parser.rows):
                    out.append((*row[:-1], position, path, group, value, cursor, cursor + len(value)))
                    cursor += len(value) + 1
            frame = pd.DataFrame(out, columns=columns)
            frame["row_group"] = frame["row_group"].astype("Int32")
            yield frame

    return pages.select(*ids, html).mapInPandas(parse, schema)
