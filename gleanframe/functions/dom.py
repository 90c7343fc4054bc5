"""Extraction rules over node arrays, as Catalyst expressions.

A :class:`Page` wraps the two arrays of one parsed page. All rules are higher-order
functions over them, so nothing shuffles and nothing goes back to Python. Two narrow
arrays are projected first and everything else works on those:

``marks``       elements that any selector of the source can match
``label_hits``  cells, terms and strings that can start with one of the source's labels
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanframe.functions.binding import constant, let
from gleanframe.functions.text import blank_to_null, clean_text

Selector = Callable[[Column], Column]

# Fixed value: elements that can carry a label next to their value.
LABEL_TAGS = ("dt", "th", "label", "span", "div", "p", "td")
CELL_TAGS = ("th", "td")
# Fixed value: characters around a label that do not belong to it.
LABEL_EDGE = " :№-"


# --- selectors -----------------------------------------------------------------------


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _bare(match: Selector, *tags: str, rule: tuple) -> Selector:
    """Note the tags a selector can match on elements without attributes, and the selector as data.

    ``rule`` is (attribute, kind of test, value, tag or None), as ``sources.skeletons`` reads it.
    """
    match.bare_tags = tags
    match.rule = rule
    return match


def by_tag(name: str) -> Selector:
    return _bare(lambda n: n["tag"] == name, name, rule=("", "tag", "", name))


def by_class(name: str, tag: str | None = None) -> Selector:
    def match(n: Column) -> Column:
        found = F.contains(F.concat(F.lit(" "), attr(n, "class"), F.lit(" ")), F.lit(f" {name} "))
        return found if tag is None else (n["tag"] == tag) & found

    return _bare(match, rule=("class", "word", name, tag))


def by_attr(name: str, value: str | None = None, part: str | None = None, tag: str | None = None) -> Selector:
    """Attribute present, equal to ``value``, or containing ``part``."""

    def match(n: Column) -> Column:
        found = attr(n, name)
        if value is not None:
            test = found == value
        elif part is not None:
            test = F.contains(found, F.lit(part))
        else:
            test = found.isNotNull()
        return test if tag is None else (n["tag"] == tag) & test

    if value is not None:
        return _bare(match, rule=(name, "value", value, tag))
    return _bare(match, rule=(name, "present" if part is None else "part", part or "", tag))


def any_of(selectors: Iterable[Selector]) -> Selector:
    selectors = list(selectors)
    return lambda n: reduce(lambda a, b: a | b, [F.coalesce(s(n), F.lit(False)) for s in selectors])


# --- labels --------------------------------------------------------------------------


def label_key(label: str) -> str:
    return " ".join(label.split()).strip(LABEL_EDGE).casefold()


def text_key(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(LABEL_EDGE)))


def _keys(labels: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(label_key(label) for label in labels))


# One list of labels as data: keys to compare with, and prefixes for inline values.
LABELS_TYPE = "array<struct<keys:array<string>,prefixes:array<struct<prefix:string,cut:int,key:string>>>>"


def label_groups(groups: Iterable[Iterable[str]]) -> Column:
    def group(labels: Iterable[str]) -> dict:
        labels = list(labels)
        return {
            "keys": _keys(labels),
            "prefixes": [
                {
                    "prefix": " ".join(label.split()).casefold(),
                    "cut": len(label) + 1,
                    "key": label_key(label),
                }
                for label in labels
            ],
        }

    return constant([group(g) for g in groups], LABELS_TYPE)


def inline_value(text: Column, lowered: Column, prefixes: Column) -> Column:
    """Rest of a text that starts with one of the labels; null if there is none."""

    def rest_after(acc: Column, p: Column) -> Column:
        rest = F.ltrim(F.substr(text, p["cut"]), F.lit(LABEL_EDGE))
        usable = (rest != "") & (text_key(rest) != p["key"])
        return F.coalesce(acc, F.when(lowered.startswith(p["prefix"]) & usable, rest))

    return F.aggregate(prefixes, F.lit(None).cast("string"), rest_after)


class Page:
    """The node array of one page; ``scope`` limits rules to the subtree of one node."""

    def __init__(self, texts: Column, nodes: Column) -> None:
        self.texts = texts
        self.nodes = nodes

    def joined(self, n: Column) -> Column:
        count = n["t1"] - n["t0"]
        return F.coalesce(
            n["text"],
            F.when(count <= 0, F.lit(""))
            .when(count == 1, F.get(self.texts, n["t0"]))
            .otherwise(F.array_join(F.slice(self.texts, n["t0"] + 1, count), " ")),
        )

    def text_of(self, n: Column) -> Column:
        """Readable text of a node; '' for comments and other hidden strings, null for no node."""
        return F.when(n["kind"] == "x", F.lit("")).when(n["kind"].isNotNull(), self.joined(n))

    def page_text(self) -> Column:
        return F.coalesce(let(F.get(self.nodes, F.lit(0)), self.text_of), F.lit(""))

    def siblings_after(self, parent: Column, last: Column) -> Column:
        """Later siblings of a node that ends at ``last``, in order."""
        end = F.get(self.nodes, parent)["last"]
        rest = F.slice(self.nodes, last + 2, F.greatest(end - last, F.lit(0)))
        return F.filter(rest, lambda m: m["parent"] == parent)

    # --- narrow arrays ---

    def marks(self, selectors: Iterable[Selector]) -> Column:
        selectors = list(selectors)
        match, known = any_of(selectors), [getattr(s, "bare_tags", None) for s in selectors]
        if None in known:
            return F.filter(self.nodes, lambda n: (n["kind"] == "e") & match(n))
        # Most elements have no attributes: they are settled by their tag before any selector is tried.
        bare = F.array(*[F.lit(t) for t in dict.fromkeys(t for tags in known for t in tags)]).cast("array<string>")
        return F.filter(
            self.nodes,
            lambda n: (n["kind"] == "e") & ((F.size(n["attrs"]) > 0) | F.array_contains(bare, n["tag"])) & match(n),
        )

    def label_hits(self, labels: Iterable[str]) -> Column:
        """Nodes whose text can start with a label, ordered as in the document.

        Field order puts ``parent`` and ``i`` first, so sorting hits puts them row by row.
        """
        keys = _keys(labels)
        # The look at the first letter rejects most texts before the labels are tried.
        letters = "".join(sorted({re.escape(k[0]) for k in keys}))
        starts = f"(?iu)^[{LABEL_EDGE}]*+(?=[{letters}])(?:" + "|".join(map(re.escape, keys)) + ")"
        key_array = F.array(*[F.lit(k) for k in keys])

        # Each string is tried once: an element whose first string starts with a label does so too.
        labelled = F.transform(self.texts, lambda t: t.rlike(starts))

        def may_match(n: Column, by_text: Column) -> Column:
            # Long joined text is only built if its first string leaves a match possible.
            first = text_key(F.get(self.texts, n["t0"]))
            count = n["t1"] - n["t0"]
            long = n["text"].isNull() & (count > 1)
            possible = F.exists(key_array, lambda k: k.startswith(first) | first.startswith(k))
            return (
                F.when((n["kind"] != "x") & ((count == 1) | ((count > 1) & F.get(by_text, n["t0"]))), F.get(by_text, n["t0"]))
                .when(long & ~possible, F.lit(False))
                .otherwise(self.joined(n).rlike(starts))
            )

        hits = let(
            labelled,
            lambda by_text: F.filter(
                self.nodes,
                lambda n: (n["kind"].isin("s", "x") | n["tag"].isin(*LABEL_TAGS)) & may_match(n, by_text),
            ),
        )
        fields = ("parent", "i", "last", "eq", "kind", "tag", "leaf")
        texted = F.transform(
            hits,
            lambda n: F.struct(*[n[f].alias(f) for f in fields], self.joined(n).alias("txt")),
        )
        keyed = F.transform(texted, lambda h: h.withField("low", F.lower(h["txt"])))
        return F.transform(keyed, lambda h: h.withField("key", F.btrim(h["low"], F.lit(LABEL_EDGE))))

    # --- selectors over marks ---

    def first_node(self, marks: Column, selectors: Sequence[Selector], scope: Column | None = None) -> Column:
        return F.coalesce(*[F.get(self.select(marks, s, scope), F.lit(0)) for s in selectors])

    def select(self, marks: Column, selector: Selector, scope: Column | None = None) -> Column:
        # Places are cheaper to compare than attributes.
        return F.filter(marks, lambda n: _inside(n, scope) & selector(n))

    def first_text(self, marks: Column, selectors: Sequence[Selector], scope: Column | None = None) -> Column:
        found = let(self.first_node(marks, selectors, scope), self.text_of)
        return F.coalesce(found, F.lit(""))

    def first_attr(self, marks: Column, selectors: Sequence[Selector], name: str) -> Column:
        return clean_text(attr(self.first_node(marks, selectors), name))

    # --- labelled values ---

    def labeled_values(
        self, hits: Column, groups: Iterable[Iterable[str]], scope: Column | None = None
    ) -> Column:
        """For each group of labels, the value next to one of them (null if none).

        Table rows first, then definition lists, then elements and at last bare strings in
        document order; the first value found wins. The groups are data, so the rule is
        planned once however many fields a source has.
        """
        return F.transform(label_groups(groups), lambda g: self._labeled_value(hits, g, scope))

    def labeled_value(self, hits: Column, labels: Iterable[str], scope: Column | None = None) -> Column:
        return F.get(self.labeled_values(hits, [labels], scope), F.lit(0))

    def _labeled_value(self, hits: Column, group: Column, scope: Column | None) -> Column:
        keys = group["keys"]

        def first(candidates: Column, value: Callable[[Column], Column]) -> Column:
            # coalesce is lazy: once a value is found the other candidates cost nothing.
            none = F.lit(None).cast("string")
            return F.aggregate(candidates, none, lambda acc, h: F.coalesce(acc, value(h)))

        def labelled(h: Column) -> Column:
            return F.array_contains(keys, h["key"])

        def concerned(h: Column) -> Column:
            # Other hits are another group's and give null under every rule below.
            return labelled(h) | (h["leaf"] & F.exists(group["prefixes"], lambda p: h["low"].startswith(p["prefix"])))

        def in_row(h: Column) -> Column:
            row = F.get(self.nodes, h["parent"])
            in_scope = F.lit(True) if scope is None else row["i"] > scope["i"]
            return h["tag"].isin(*CELL_TAGS) & labelled(h) & (row["tag"] == "tr") & in_scope

        def cell_or_definition(h: Column) -> Column:
            wanted = F.filter(
                self.siblings_after(h["parent"], h["last"]),
                lambda m: F.when(h["tag"] == "dt", m["tag"] == "dd").otherwise(m["tag"].isin(*CELL_TAGS)),
            )
            return blank_to_null(let(F.get(wanted, F.lit(0)), self.text_of))

        def beside(h: Column) -> Column:
            return F.coalesce(
                F.when(h["leaf"], inline_value(h["txt"], h["low"], group["prefixes"])),
                F.when(labelled(h), self._following(h, keys)),
            )

        def rule(scoped: Column) -> Column:
            # Rows first, then cells in a row: an outer row comes before the rows nested in it.
            cells = F.array_sort(F.filter(scoped, in_row))
            terms = F.filter(scoped, lambda h: (h["tag"] == "dt") & labelled(h))
            elements = F.filter(scoped, lambda h: h["kind"] == "e")
            strings = F.filter(scoped, lambda h: h["kind"] != "e")
            return F.coalesce(
                first(cells, cell_or_definition),
                first(terms, cell_or_definition),
                first(elements, beside),
                first(strings, beside),
            )

        return let(F.filter(hits, lambda h: _inside(h, scope) & concerned(h)), rule)

    def _following(self, h: Column, keys: Column) -> Column:
        """First later sibling with text that is no label, else what the parent adds."""

        def is_value(t: Column) -> Column:
            return (t != "") & ~F.array_contains(keys, text_key(t))

        twin_end = F.get(self.nodes, h["eq"])["last"]
        later = F.transform(self.siblings_after(h["parent"], twin_end), self.text_of)
        own = F.when(h["kind"] == "x", F.lit("")).otherwise(h["txt"])
        rest = let(
            let(F.get(self.nodes, h["parent"]), self.text_of),
            lambda whole: F.when(
                whole.startswith(own), F.ltrim(F.substr(whole, F.length(own) + 1), F.lit(LABEL_EDGE))
            ),
        )
        return F.coalesce(
            F.get(F.filter(later, is_value), F.lit(0)), let(rest, lambda r: F.when(is_value(r), r))
        )


def _inside(n: Column, scope: Column | None) -> Column:
    if scope is None:
        return F.lit(True)
    return (n["i"] > scope["i"]) & (n["i"] <= scope["last"])


# --- JSON-LD -------------------------------------------------------------------------


def json_ld_objects(nodes: Column) -> Column:
    """All JSON-LD objects of a page; lists are flattened, bad JSON is skipped."""
    scripts = F.filter(nodes, lambda n: n["raw"].isNotNull())
    parsed = F.transform(scripts, lambda n: F.try_parse_json(n["raw"]))
    parsed = F.filter(parsed, lambda v: v.isNotNull())
    items = F.flatten(
        F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    )
    return F.filter(items, is_object)


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def json_ld_of_type(objects: Column, wanted: str) -> Column:
    """First object of a type, looking into each object's ``@graph`` in turn."""
    type_path = "$['@type']"

    def named(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, type_path, "string") == wanted, F.lit(False))

    def own_type(v: Column) -> Column:
        listed = F.try_variant_get(v, type_path, "array<string>")
        return named(v) | F.coalesce(F.array_contains(listed, wanted), F.lit(False))

    def in_graph(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return F.get(F.filter(graph, lambda g: is_object(g) & named(g)), F.lit(0))

    found = F.transform(objects, lambda v: F.when(own_type(v), v).otherwise(in_graph(v)))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def json_text(v: Column, path: str) -> Column:
    """Scalar of a JSON object as clean text, '' if absent or null."""
    return clean_text(F.try_variant_get(v, path, "string"))
