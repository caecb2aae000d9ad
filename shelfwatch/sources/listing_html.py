"""Listing pages read with a selector map: one record per product card.

HTML trees have no built-in in Spark, so the cards are cut out in Arrow batches with the standard library's parser.
Only raw texts and attributes leave Python; prices, urls and stock are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.functions.prices import with_price
from shelfwatch.functions.stock import classify_stock
from shelfwatch.functions.text import blank_to_null, category_from_url, first_filled
from shelfwatch.functions.urls import resolve_url
from shelfwatch.sources.catalogs import PAGE_STRIDE

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CARD_SCHEMA = (
    "competitor_id long, page_ix long, url string, base_url string, card_ix long, title_text string, card_text string, "
    "price_text string, href string, src string, stock_text string"
)
SELECTORS = {"product_card": "", "title": "", "price": "", "url": "a", "image": "img", "stock": ""}


class _Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def descendants(self):
        stack = [p for p in reversed(self.parts) if isinstance(p, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, _Node))

    def text(self):
        stack, out = list(reversed(self.parts)), []
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in ("script", "style"):
                stack.extend(reversed(part.parts))
        return " ".join(" ".join(out).split())


class _Tree(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.open)
        self.open.parts.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.parts.append(_Node(tag, dict(attrs), self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.parts.append(data)


def _fits(node: _Node, simple: str) -> bool:
    """One compound selector: tag, .class, #id, [attr] in any combination."""
    for part in re.findall(r"\[[^\]]+\]|[.#]?[^.#\[]+", simple):
        if part[0] == ".":
            if part[1:] not in (node.attrs.get("class") or "").split():
                return False
        elif part[0] == "#":
            if node.attrs.get("id") != part[1:]:
                return False
        elif part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            if name not in node.attrs or (value and node.attrs[name] != value.strip("'\"")):
                return False
        elif part != "*" and node.tag != part.lower():
            return False
    return True


def _select(scope: _Node, selector: str) -> Iterator[_Node]:
    """Descendants of `scope` that match any of the comma-separated descendant selectors, in page order."""
    chains = [c.split() for c in (selector or "").split(",") if c.strip()]
    for node in scope.descendants():
        for chain in chains:
            if not _fits(node, chain[-1]):
                continue
            above, wanted = node.parent, chain[:-1]
            while wanted and above is not None:
                if _fits(above, wanted[-1]):
                    wanted = wanted[:-1]
                above = above.parent
            if not wanted:
                yield node
                break


def _cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in CARD_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for page in batch.itertuples(index=False):
            def text(card, selector):
                found = next(_select(card, selector), None)
                return found.text() if found is not None else ""

            def attribute(card, selector, *attributes):
                found = next(_select(card, selector), None)
                return next((found.attrs[a] for a in attributes if found.attrs.get(a)), None) if found is not None else None

            for ix, card in enumerate(_select(_Tree(page.html or "").root, page.product_card)):
                rows.append((
                    page.competitor_id, page.page_ix, page.page_url, page.base_url, ix, text(card, page.title), card.text(),
                    text(card, page.price), attribute(card, page.link, "href"), attribute(card, page.image, "src", "data-src"),
                    text(card, page.stock),
                ))
        yield pd.DataFrame(rows, columns=names)


def extract_listing_cards(pages: DataFrame, currency: str = "USD") -> DataFrame:
    """Records of pages (competitor_id, page_ix, url, base_url, selectors map, html)."""
    chosen = {n: F.coalesce(F.col("selectors")[n], F.lit(d)) for n, d in SELECTORS.items()}
    chosen["link"] = chosen.pop("url")
    wanted = pages.where(F.col("selectors")["product_card"] != "").select(
        F.col("competitor_id").cast("long"), F.col("page_ix").cast("long"), F.col("url").alias("page_url"), "base_url", "html",
        *[v.alias(n) for n, v in chosen.items()],
    )
    cards = wanted.mapInPandas(_cards, CARD_SCHEMA)
    c = F.col
    rows = with_price(cards, c("price_text"), currency).withColumns({
        # Without a title element the card's own text stands in.
        "title": first_filled(c("title_text"), c("card_text")),
        "link": resolve_url(c("href"), c("base_url")),
    })
    none = F.lit(None).cast("string")
    return rows.where("link <> '' and title <> ''").select(
        "competitor_id", (c("page_ix") * PAGE_STRIDE + c("card_ix")).alias("item_ix"), c("link").alias("url"),
        none.alias("external_id"), "title", "price", "currency",
        classify_stock(c("stock_text")).alias("stock_status"), none.alias("sku"),
        resolve_url(blank_to_null(c("src")), c("base_url")).alias("image_url"), category_from_url(c("url")).alias("category"),
    )
