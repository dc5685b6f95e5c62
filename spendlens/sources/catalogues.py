"""Store catalogues: JSON payloads by `from_json`, HTML pages by parsers run in Arrow batches.

Each page or payload gives at most its first 12 offers, as the feature is
defined; a payload that can't be read gives none. Every function returns
store_id, page (where the payloads have one), ordinal (place in the payload),
name, price, list_price, url, image, available.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spendlens.functions import numbers

FIRST = 12
OFFER = "store_id long, ordinal int, name string, price double, list_price double, url string, image string, available boolean"
_VTEX_ITEM = "struct<productName:string,linkText:string,items:array<struct<images:array<struct<imageUrl:string>>,sellers:array<struct<commertialOffer:struct<Price:double,AvailableQuantity:int>>>>>>"
_GRAPH_NODE = (
    "struct<name:string,slug:string,isVariantOf:struct<name:string>,image:array<struct<url:string>>,"
    "offers:struct<lowPrice:double,offers:array<struct<price:double,listPrice:double,availability:string>>>>"
)


def keys(rows: DataFrame) -> list[str]:
    return ["store_id", "page"] if "page" in rows.columns else ["store_id"]


def first_offers(rows: DataFrame) -> DataFrame:
    """Numbers each payload's offers in their order and keeps the first 12: arrays of one payload, never a whole store."""
    kept = F.slice("offers", 1, FIRST)
    return rows.select(*keys(rows), F.posexplode(kept).alias("pos", "o")).select(
        *keys(rows), F.col("pos").alias("ordinal"), *(F.col(f"o.{c}").alias(c) for c in ("name", "price", "list_price", "url", "image", "available"))
    )


def union(found: list[DataFrame]) -> DataFrame:
    """The offers of several parsers' pages (with `page`) as one relation: store_id, ordinal long (unique in a store), name, price, url, available.

    A parser that finds nothing adds nothing; no store's rows meet in one task.
    """
    parts = [f.select("store_id", (F.col("page") * FIRST + F.col("ordinal")).cast("long").alias("ordinal"), "name", "price", "url", "available") for f in found]
    return functools.reduce(DataFrame.unionByName, parts)


def _offer(name: Column, price: Column, list_price: Column, url: Column, image: Column, available: Column) -> Column:
    return F.struct(name.alias("name"), price.alias("price"), list_price.cast("double").alias("list_price"), url.alias("url"), image.alias("image"), available.alias("available"))


def product_json(payloads: DataFrame) -> DataFrame:
    """A catalogue array, bare or under `products`; the first item's first seller counts; no price, no offer. Columns store_id, base_url, payload."""
    bare = F.from_json("payload", f"array<{_VTEX_ITEM}>")
    under = F.from_json("payload", f"struct<products:array<{_VTEX_ITEM}>>")["products"]
    listed = F.when(F.trim("payload").startswith("["), bare).otherwise(under)
    offer = lambda p: F.get(F.get(p["items"], F.lit(0))["sellers"], F.lit(0))["commertialOffer"]
    priced = F.filter(listed, lambda p: F.coalesce(offer(p)["Price"] != 0, F.lit(False)))
    return first_offers(payloads.withColumn("offers", F.transform(priced, lambda p: _offer(
        p["productName"], offer(p)["Price"], F.lit(None), F.concat("base_url", F.lit("/"), p["linkText"], F.lit("/p")),
        F.get(F.get(p["items"], F.lit(0))["images"], F.lit(0))["imageUrl"], F.coalesce(offer(p)["AvailableQuantity"] > 0, F.lit(False)),
    ))))


def graph_json(payloads: DataFrame, strict: bool = True) -> DataFrame:
    """Edges and nodes of a graph query. strict: the low price only, and available only if said so; else the first offer's price too, available by default."""
    edges = F.from_json("payload", f"struct<data:struct<search:struct<products:struct<edges:array<struct<node:{_GRAPH_NODE}>>>>>>")["data"]["search"]["products"]["edges"]
    own = lambda n: F.get(n["offers"]["offers"], F.lit(0))
    price = lambda n: n["offers"]["lowPrice"] if strict else F.coalesce(n["offers"]["lowPrice"], own(n)["price"])
    stock = lambda n: F.coalesce(own(n)["availability"].rlike("(?i)InStock"), F.lit(not strict))
    good = F.filter(F.transform(edges, lambda e: e["node"]), lambda n: F.coalesce((n["name"] != "") & (price(n) > 0), F.lit(False)))
    return first_offers(payloads.withColumn("offers", F.transform(good, lambda n: _offer(
        F.coalesce(n["isVariantOf"]["name"], n["name"]), price(n), own(n)["listPrice"], F.concat("base_url", F.lit("/"), n["slug"], F.lit("/p")), F.get(n["image"], F.lit(0))["url"], stock(n),
    ))))


_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|\[|\]', re.S)


def bracketed(text: str, mark: str) -> str | None:
    """The JSON array that starts at the `[` which ends `mark`, found by the depth of brackets outside strings."""
    at = text.find(mark)
    if at < 0:
        return None
    start, depth = at + len(mark) - 1, 0
    for m in _BRACKET.finditer(text, start):
        depth += (m[0] == "[") - (m[0] == "]")
        if not depth:
            return text[start : m.end()]
    return None


def _own(pages: DataFrame) -> DataFrame:
    return pages.select(*(F.col(c).cast("long") for c in keys(pages)), "base_url", "payload")


def embedded_json(pages: DataFrame) -> DataFrame:
    """Products in a script of a page (`"Product":[...]`); those not for sale or sold out go; every digit of a price counts; codes have six digits at least."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(payload=[bracketed(t or "", '"Product":[') for t in b.payload])

    found = _own(pages).mapInPandas(find, _own(pages).schema)
    listed = F.from_json("payload", "array<struct<Name:string,Code:string,Price:string,Image:string,NotForSale:boolean,Soldout:boolean>>")
    code = lambda p: F.when(F.length(p["Code"]) < 6, F.lpad(p["Code"], 6, "0")).otherwise(p["Code"])
    price = lambda p: F.regexp_replace(p["Price"], "[^0-9]", "").try_cast("double")
    good = F.filter(listed, lambda p: ~F.coalesce(p["NotForSale"], F.lit(False)) & ~F.coalesce(p["Soldout"], F.lit(False)) & F.coalesce(price(p) > 0, F.lit(False)))
    return first_offers(found.withColumn("offers", F.transform(good, lambda p: _offer(p["Name"], price(p), F.lit(None), F.concat("base_url", F.lit("/p/"), code(p)), p["Image"], F.lit(True)))))


class Node:
    """An element of a page: tag, attributes, children and text."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        out, left = [], list(reversed(self.children))
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                left.extend(reversed(c.children))
        return "".join(out)

    def all(self, tag: str = "", cls: str = "", **attrs: str) -> Iterator[Node]:
        left = [c for c in reversed(self.children) if isinstance(c, Node)]
        while left:
            c = left.pop()
            if (not tag or c.tag == tag) and set(cls.split()) <= set(c.attrs.get("class", "").split()) and all(v in c.attrs.get(k, "") for k, v in attrs.items()):
                yield c
            left.extend(x for x in reversed(c.children) if isinstance(x, Node))

    def first(self, tag: str = "", cls: str = "", **attrs: str) -> Node:
        return next(self.all(tag, cls, **attrs), Node("", {}))


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.stack = [self.root]

    #: What an element that is left open ends at: the next of its kind, and of those around it.
    ENDS = {"p": ("p",), "li": ("li",), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}

    def handle_starttag(self, tag, attrs):
        while len(self.stack) > 1 and self.stack[-1].tag in self.ENDS.get(tag, ()):
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in self.VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def tree(page: str | None) -> Node:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


Found = tuple[str, str, str, str]  # name, price text, url, image


def keyword_page(root: Node) -> Iterator[Found]:
    for p in root.all(cls="product-item"):
        a = p.first(cls="prod-desc").first("h3").first("a")
        yield a.text().strip(), p.first(cls="desc-prices").first(cls="val").text(), a.attrs.get("href", ""), p.first("figure").first("img").attrs.get("src", "")


def info_page(root: Node) -> Iterator[Found]:
    for parent in root.all():
        for p in (c for c in parent.children if isinstance(c, Node) and "info" in c.attrs.get("class", "").split()):
            a = p.first("a")
            image = next((i.attrs.get("src", "") for i in parent.all("img") if not any(w in i.attrs.get("src", "") for w in ("descuento", "discount"))), "")
            yield a.attrs.get("title", "").strip() or p.first("h2").text().strip(), p.first(cls="monto").text(), a.attrs.get("href", ""), image


def last_price_page(root: Node) -> Iterator[Found]:
    for p in root.all(cls="product-item"):
        prices = list(p.all("span", "price"))
        link = p.first("a", "product photo").attrs.get("href") or p.first("a", href=".html").attrs.get("href", "")
        yield p.first("h2").text().strip(), prices[-1].text() if prices else "", link, p.first("img", "product-image-photo").attrs.get("src", "")


def scoped_page(root: Node) -> Iterator[Found]:
    scope = next(root.all(id="catalogoProductos"), root)
    seen = set()
    for p in scope.all("div", "cnt"):
        a = p.first("a", "img")
        url = a.attrs.get("href", "")
        if url and a.attrs.get("title") and url not in seen:
            seen.add(url)
            yield a.attrs["title"], p.first("strong", "precio").first(cls="monto").text(), url, p.first("img").attrs.get("src", "")


def lazy_page(root: Node) -> Iterator[Found]:
    for p in root.all(cls="product"):
        a, image = p.first("a"), p.first("img").attrs
        yield p.first("h3").text().strip() or a.attrs.get("title", ""), p.first(cls="price").text(), a.attrs.get("href", ""), image.get("data-src") or image.get("src", "")


LAYOUTS: dict[str, Callable[[Node], Iterator[Found]]] = {
    "keyword": keyword_page, "info": info_page, "last_price": last_price_page, "scoped": scoped_page, "lazy": lazy_page,
}


def html_pages(pages: DataFrame, layout: str) -> DataFrame:
    """The offers of catalogue pages of a layout of LAYOUTS, each page in the task that reads it. Columns store_id, base_url, payload (html), page if wanted."""
    find = LAYOUTS[layout]
    own = _own(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="payload").assign(found=[[dict(zip(("name", "text", "url", "image"), f)) for f in find(tree(page))] for page in b.payload])

    kept = ", ".join(f"{c} long" for c in keys(pages))
    found = own.mapInPandas(run, f"{kept}, base_url string, found array<struct<name:string,text:string,url:string,image:string>>")
    whole = lambda o: F.when(o["url"].startswith("http"), o["url"]).otherwise(F.concat("base_url", o["url"]))
    offers = F.transform("found", lambda o: _offer(o["name"], numbers.parse_price(o["text"]), F.lit(None), whole(o), F.nullif(o["image"], F.lit("")), F.lit(True)))
    return first_offers(found.withColumn("offers", F.filter(offers, lambda o: F.coalesce((o["price"] > 0) & (o["name"] != ""), F.lit(False)))))


def outline(pages: DataFrame) -> DataFrame:
    """page_id, title, n_links, n_headings of whole pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            roots = [tree(h) for h in b.html]
            yield pd.DataFrame({
                "page_id": b.page_id, "title": [" ".join(r.first("title").text().split()) for r in roots],
                "n_links": [sum(1 for a in r.all("a") if "href" in a.attrs) for r in roots], "n_headings": [sum(1 for t in ("h1", "h2", "h3") for _ in r.all(t)) for r in roots],
            })

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, n_links long, n_headings long")
