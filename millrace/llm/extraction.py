"""HTML extraction: the article text of pages, block by block.

The driver trains the labeller once (a bounded set of composed pages) and
sends its weights, a fixed number of values, to the tasks.  Tasks parse pages
to blocks, label every block with the whole page in view, and join the blocks
kept by line ends.  No shuffle.

Edge cases: null and empty html give empty text; a page without article
blocks gives empty text; repeated rows are labelled each; an empty table gives
an empty result; other columns than page_id, url and html aren't read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from .common import blocks, map_batches
from .labeller import features, trained
from .pages import blocks_of


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def work(frames):
        for frame in blocks(frames, "html", 2_000_000):
            found = [blocks_of(h) if isinstance(h, str) else [] for h in frame["html"]]
            odds = shared.value.score([features(f) if f else features([]) for f in found])
            text = ["\n".join(b.text for b, o in zip(f, s) if o > 0) for f, s in zip(found, odds)]
            yield pd.DataFrame({"page_id": frame["page_id"].to_numpy(), "url": frame["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return map_batches(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long", ("page_id",))
