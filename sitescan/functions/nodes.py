"""HTML to node rows: the one place where Python reads a page.

Reading tag soup needs a stack of open elements, which SQL expressions cannot
hold at a fair price. So one Arrow function turns each page into an array of
nodes in document order, and every later step is a Column expression on that
array. Node `i` sits at position `i`, and its subtree is the run of nodes
`i + 1 .. last`, so subtrees are slices.
"""

import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..lookups import BOILERPLATE_TAGS
from .json_text import plain_json

# The reader travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements that never have content, and elements whose strings are not page text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr"
    " basefont bgsound command frame image isindex nextid spacer".split()
)
QUIET_TAGS = frozenset(("script", "style", "template", "rt", "rp"))
# Structured data, and the attribute of its script that holds it as plain JSON where the text is not.
LINKED_DATA = "application/ld+json"
PLAIN_JSON = "#json"
# Attributes the built-in operators look at.
USED_ATTRS = ("id", "class", "rel", "type", "property", "name", "content", "href")

# Pages, and characters of pages, whose nodes a worker holds at once.
PORTION_PAGES, PORTION_CHARS = 64, 1 << 20

NODE_TYPE = (
    "struct<id:int,parent:int,last:int,tag:string,kind:string,cut:boolean,"
    "attrs:map<string,string>,text:string>"
)
PARSED_TYPE = f"struct<nodes:array<{NODE_TYPE}>,error:string>"


class _NodeReader(HTMLParser):
    """Collects the nodes of one page as parallel lists.

    There are no implied end tags: an element stays open until its own end tag
    or that of an element around it. End tags that match nothing are ignored.
    """

    def __init__(self, cut_tags, attr_names):
        super().__init__(convert_charrefs=False)
        self.cut_tags, self.attr_names = cut_tags, attr_names
        self.parent, self.last, self.tag, self.kind = [], [], [], []
        self.cut, self.attrs, self.text = [], [], []
        self.open_ids, self.open_count = [], {}
        self.open_cut = 0
        self.quiet = []
        self.words = []

    def updatepos(self, i, j):
        # Line numbers are of no use here.
        return j

    def _add(self, tag, kind, cut, attrs, text):
        self.parent.append(self.open_ids[-1] if self.open_ids else -1)
        self.last.append(len(self.tag))
        self.tag.append(tag)
        self.kind.append(kind)
        self.cut.append(cut)
        self.attrs.append(attrs)
        self.text.append(text)

    def _flush(self):
        if not self.words:
            return
        text = "".join(self.words)
        self.words.clear()
        # White space counts only where an element's single string is asked for.
        if text.isspace() and not self.open_count.get("title"):
            return
        if self.attr_names is not None and self.quiet and self.quiet[-1] == "script":
            script = self.attrs[self.open_ids[-1]]
            if script.get("type") == LINKED_DATA:
                plain = plain_json(text)
                if plain is not None:
                    script[PLAIN_JSON] = _clean(plain)
        self._add("#text", self.quiet[-1] if self.quiet else "", self.open_cut > 0, None, text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        if self.attr_names is not None:
            attrs = [(k, v) for k, v in attrs if k in self.attr_names]
        cuts = tag in self.cut_tags
        self._add(tag, None, cuts or self.open_cut > 0, {k: v or "" for k, v in attrs}, None)
        if tag in VOID_TAGS:
            return
        self.open_ids.append(len(self.tag) - 1)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        self.open_cut += cuts
        if tag in QUIET_TAGS:
            self.quiet.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        while self.open_count.get(tag):
            node = self.open_ids.pop()
            name = self.tag[node]
            self.last[node] = len(self.tag) - 1
            self.open_count[name] -= 1
            self.open_cut -= name in self.cut_tags
            if name in QUIET_TAGS:
                self.quiet.pop()
            if name == tag:
                break

    def handle_data(self, data):
        self.words.append(data)

    def handle_entityref(self, name):
        self.words.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        if 0 < code < 256:
            char = bytes([code]).decode("cp1252", "ignore") or chr(code)
        elif 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            char = chr(code)
        else:
            char = "\N{REPLACEMENT CHARACTER}"
        self.words.append(char)

    def handle_comment(self, data):
        self._flush()
        self._add("#comment", None, self.open_cut > 0, None, data)

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self.words.append(data[6:])
            self._flush()
        else:
            self.handle_comment(data)

    def finish(self):
        self.close()
        self._flush()
        for node in self.open_ids:
            self.last[node] = len(self.tag) - 1


def read_nodes(html, cut_tags=frozenset(BOILERPLATE_TAGS), attr_names=None):
    reader = _NodeReader(cut_tags, attr_names)
    reader.feed(html)
    reader.finish()
    return reader


def _nodes_array(pages):
    """Arrow array of node lists; `pages` holds readers, or None for no nodes."""
    ids, parent, last, tag, kind, cut, text = [], [], [], [], [], [], []
    offsets, attr_offsets, names, values = [], [], [], []
    end = attr_end = 0
    for page in pages:
        if page is None:
            offsets.append(None)
            continue
        offsets.append(end)
        size = len(page.tag)
        ids.extend(range(size))
        for target, source in (
            (parent, page.parent), (last, page.last), (tag, page.tag),
            (kind, page.kind), (cut, page.cut), (text, page.text),
        ):
            target.extend(source)
        for attrs in page.attrs:
            attr_offsets.append(None if attrs is None else attr_end)
            if attrs:
                names.extend(attrs)
                values.extend(attrs.values())
                attr_end += len(attrs)
        end += size
    offsets.append(end)
    attr_offsets.append(attr_end)
    fields = {
        "id": pa.array(ids, pa.int32()),
        "parent": pa.array(parent, pa.int32()),
        "last": pa.array(last, pa.int32()),
        "tag": pa.array(tag, pa.string()),
        "kind": pa.array(kind, pa.string()),
        "cut": pa.array(cut, pa.bool_()),
        "attrs": pa.MapArray.from_arrays(
            pa.array(attr_offsets, pa.int32()),
            pa.array(names, pa.string()),
            pa.array(values, pa.string()),
        ),
        "text": pa.array(text, pa.string()),
    }
    nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def _clean(text):
    return text.encode("utf-8", "replace").decode("utf-8")


def _portions(batch, most_pages, most_chars):
    """Pages of a batch in runs of bounded size, as lists of texts; a longer page is a run of its own."""
    texts, chars = [], 0
    for value in batch:
        text = value.as_py()
        if texts and (len(texts) == most_pages or chars + len(text or "") > most_chars):
            yield texts
            texts, chars = [], 0
        texts.append(text)
        chars += len(text or "")
    if texts:
        yield texts


def parse_html(html, cut_tags=BOILERPLATE_TAGS, attrs=USED_ATTRS):
    """Column with a page's nodes, or the reason why it could not be read.

    NULL html has no nodes and no error. `attrs=None` keeps every attribute. Nodes leave for the JVM
    after every few pages, so a worker holds those of one portion, however many rows Spark sends at once.
    """
    cut_tags = frozenset(cut_tags)
    attr_names = None if attrs is None else frozenset(attrs)

    def read(html_text):
        if not html_text:
            return None, None
        try:
            return read_nodes(html_text, cut_tags, attr_names), None
        except Exception as exc:  # a broken page is a row, not a failed job
            return None, _clean(f"{type(exc).__name__}: {exc}")

    @F.arrow_udf(PARSED_TYPE)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _portions(batch, PORTION_PAGES, PORTION_CHARS):
                pages, errors = zip(*map(read, texts))
                yield pa.StructArray.from_arrays([_nodes_array(pages), pa.array(errors, pa.string())], names=["nodes", "error"])

    return run(html)
