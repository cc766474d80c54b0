"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tags and text runs. A tag's role is its path of containers with the tag, class and id; a text
token is a block's text under its role. Roles and text tokens whose occurrences per page are the same on all pages, their
occurrence vectors, form an equivalence class; a vector is known by sums of hashes of (page, occurrences), which Spark
adds up within tasks first, so a host with very many pages is no large group. Classes that occur on at least half of a
host's pages and on SUPPORT of them, hold several tokens, and whose spans are apart from or within one another are nested
into the host's template. The template's slot that holds the article is chosen by its unlinked text, weighed by its
markup; all article roles go together. Pages that lack their host's slot, or whose host repeats too little to have any,
use the template of all hosts together. What remains in the slots, without their boilerplate parts and the template's own
text, is the text. The page's own tags decide only where no template has a slot, or where the slot is all of the body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A token is of a template only if it is on this many pages of the host, a text only if on as many that are no copies; one
#: page proves nothing, so a host of one page is read with the template of all hosts.
SUPPORT = 2
#: Templates up to this size in all are broadcast; beyond it they are joined.
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(script|style|template|svg|iframe|textarea|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
CONTAINERS = frozenset("html head body main article section nav aside header footer div form ul ol table dl figure fieldset dialog menu details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre tr td th caption dt dd figcaption hr address summary legend title option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NEVER = frozenset("head title nav aside footer form menu dialog fieldset option".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended login signup search toolbar skip pagination pager complementary contentinfo".split())
#: Names that stories have too: their blocks go only if SUPPORT pages of the host have them. Comments, adverts, notices,
#: menus, sidebars and the like go wherever they are.
UNSURE = frozenset("side widget related recommended social share sharing reply replies respond search login signup subscribe skip toolbar pagination pager complementary".split())
#: Roles are no longer than this; blocks below count to the block above them, so that a page of any depth is read in one pass.
DEEP = 2_000
#: Words that make no other name of a boilerplate name they stand beside, as in site-footer.
AROUND = frozenset("site page global top bottom left right box block bar area wrap wrapper container section list item items slot unit inner outer widget widgets".split())
#: Blocks that go by their name; headings and inline elements never do.
NAMED = BLOCKS - frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset("article main content post entry story body articlebody maincontent".split())
WORD = re.compile(r"[A-Za-z]+")
FORM, FORM_END, WHOLE = (re.compile(x, re.I) for x in (r"<form\b", r"</form\b", r"<(?:article|main)\b"))


class Node:
    """An open element; bad: boilerplate by its tags, sure: by a name of which there is no doubt, named: the roles, from
    itself outwards, that are boilerplate by a name in doubt, inside: within an article or main."""

    __slots__ = ("tag", "role", "bad", "sure", "named", "link", "inside", "open")

    def __init__(self, tag: str, role: str, bad: bool, sure: bool, named: tuple[str, ...], link: bool, inside: bool):
        self.tag, self.role, self.bad, self.sure, self.named, self.link, self.inside, self.open = tag, role, bad, sure, named, link, inside, True


class Stack:
    """Open elements, with the places of each tag, of blocks and of containers, so that no search walks over them."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def kinds(self, tag: str) -> tuple[str, ...]:
        return (tag, *(("*block",) if tag in BLOCKS else ()), *(("*container",) if tag in CONTAINERS else ()))

    def push(self, node: Node) -> None:
        for k in self.kinds(node.tag):
            self.at.setdefault(k, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, kind: str) -> int:
        """The place of the innermost open element of a kind, 0 if there is none."""
        return self.at[kind][-1] if self.at.get(kind) else 0

    def cut(self, k: int) -> None:
        """Close the element at place k and all within it, and those closed before that are innermost then."""
        while len(self.nodes) > k or (len(self.nodes) > 1 and not self.nodes[-1].open):
            node = self.nodes.pop()
            if node.open:
                for kind in self.kinds(node.tag):
                    self.at[kind].pop()

    def close(self, k: int) -> None:
        """Close the inline element at place k alone; it stays as long as something is open within it."""
        self.nodes[k].open = False
        self.at[self.nodes[k].tag].pop()
        self.cut(len(self.nodes))


def _names(attributes: str) -> list[str]:
    """The whole names in class, id and role, in lower case."""
    return [w for m in ATTRIBUTE.finditer(attributes) if m.group(1).lower() in ("class", "id", "role") for v in m.groups()[1:] if v for w in v.lower().split()] if "=" in attributes else []


def _boilerplate(name: str) -> int:
    """0: no name of boilerplate, 1: one in doubt, 2: one without."""
    words = set(WORD.findall(name))
    if BOILERPLATE.isdisjoint(words) or not words <= BOILERPLATE | AROUND:
        return 0
    return 1 if words <= UNSURE | AROUND else 2


def _wrapping_forms(page: str) -> set[int]:
    """Where forms begin that are no part of the page but are put around it: they hold its article or most of it."""
    out = set()
    for m in FORM.finditer(page):
        end = FORM_END.search(page, m.end())
        stop = end.start() if end else len(page)
        if 2 * (stop - m.start()) > len(page) or WHOLE.search(page, m.end(), stop):
            out.add(m.start())
    return out


def events(page: str) -> Iterator[tuple[str, Node, str]]:
    """("open", node, ""), ("text", innermost node, raw text) and ("break", node, "") for a page, in order."""
    root = Node("", "", False, False, (), False, False)
    stack, at, wrapping = Stack(root), 0, _wrapping_forms(page)
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "text", stack.nodes[-1], page[at : m.start()]
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if m.group(2):
            k = stack.last(name)
            # The end of an inline element closes no block that is still open around it.
            if k and not (name not in BLOCKS and stack.last("*block") > k):
                stack.cut(k)
            elif k:
                stack.close(k)
            if name in BLOCKS:
                yield "break", stack.nodes[-1], ""
            continue
        if name in BLOCKS:
            if name in CONTAINERS or name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "td", "th"):
                # A block ends an open paragraph; a list item ends the one before it.
                k = max(stack.last("*container"), stack.last("p"), stack.last(name))
                if k and (stack.nodes[k].tag == "p" or stack.nodes[k].tag == name != "div" and name not in CONTAINERS):
                    stack.cut(k)
            yield "break", stack.nodes[-1], ""
        up = stack.nodes[-1]
        names = _names(m.group(4))
        role = up.role
        if name in BLOCKS and len(role) < DEEP:
            words = [w for n in names for w in WORD.findall(n)]
            role = f"{role}/{name}{''.join('.' + w for w in words)}"
        bad = up.bad or (name in NEVER and m.start() not in wrapping) or (name == "header" and not up.inside)
        doubt = max(map(_boilerplate, names), default=0) if name in NAMED else 0
        named = (role, *up.named) if doubt == 1 and role != up.role else up.named
        node = Node(name, role, bad, up.sure or doubt == 2, named, up.link or name == "a", up.inside or name in ("article", "main"))
        yield "open", node, ""
        if name not in VOID and not m.group(4).endswith("/"):
            stack.push(node)
    if at < len(page):
        yield "text", stack.nodes[-1], page[at:]


def _id(role: str) -> int:
    return xxhash.xxh3_64_intdigest(role.encode()) >> 1


def _token(role: str, raw: str) -> str:
    """The text token of a block of this role, blanks aside; roles start with a slash, so no role is equal."""
    return f"#{xxhash.xxh3_64_hexdigest(f'{role} {" ".join(raw.split())}'.encode())}"


def _profile(page: str) -> dict[str, list]:
    """Per role of the blocks of a page: occurrences, first and last place, letters directly in it, those in links, boilerplate.

    Text tokens outside boilerplate are listed beside the roles, without letters, and so is each role that is boilerplate
    by its name, behind a "!".
    """
    found: dict[str, list] = {}
    run: list[str] = []
    at = None

    def end(k: int) -> None:
        if at is not None and not at.bad and not at.sure and not at.named and not "".join(run).isspace():
            r = found.setdefault(_token(at.role, "".join(run)), [0, k, k, 0, 0, False])
            r[0] += 1
            r[2] = k
        run.clear()

    k = 0
    for k, (kind, node, raw) in enumerate(events(page)):
        if kind == "text":
            run.append(raw)
            at = node
        elif kind == "break" or node.tag in BLOCKS:
            end(k)
            at = None
        elif node.tag == "br":
            run.append(" ")
        if kind == "open" and node.tag in BLOCKS:
            r = found.setdefault(node.role, [0, k, k, 0, 0, node.bad or node.sure or bool(node.named)])
            r[0] += 1
            r[2] = k
            if node.named and node.named[0] == node.role:
                found["!" + node.role] = [1, k, k, 0, 0, True]
        elif kind == "text" and node.role:
            r = found.setdefault(node.role, [0, k, k, 0, 0, node.bad or node.sure or bool(node.named)])
            n = len(raw) - raw.count(" ")
            r[3] += n
            r[4] += n * node.link
            r[2] = k
    end(k)
    return found


def profiles(pages: DataFrame) -> DataFrame:
    """(host, role, n, v1, v2, first, last, letters, linked, bad) of each page's roles; pages: (host, page key, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                rows = []
                for host, key, page in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    rows.append((host, "", 1, 0, 0, 0, 0, 0, False))
                    for role, (n, first, last, letters, linked, bad) in _profile(page or "").items():
                        h = xxhash.xxh3_64_intdigest(f"{key}|{n}".encode())
                        rows.append((host, role, h & 0x3FFFFFFF, h >> 34, first, last, letters, linked, bad))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "role", "v1", "v2", "first", "last", "letters", "linked", "bad"])

    return pages.mapInArrow(run, "host string, role string, v1 long, v2 long, first long, last long, letters long, linked long, bad boolean")


def _template(roles: pd.DataFrame) -> pd.DataFrame:
    """One host's template: its classes of roles and text, nested, the slots of the article, the best first, and its text."""
    roles = roles.sort_values(["first", "role"])
    classes = [g for _, g in roles.groupby(["n", "v1", "v2"], sort=False)]
    # A class's span; it is valid if it lies within or apart from those chosen before it, largest first.
    spans, valid = [], []
    for g in sorted(classes, key=lambda g: (-g["n"].iloc[0], -len(g), g["first"].min(), g["role"].iloc[0])):
        lo, hi = g["first"].min(), g["last"].max()
        if len(g) > 1 or g["n"].iloc[0] == roles["n"].max():
            if all(hi <= a or lo >= b or (a <= lo and hi <= b) or (lo <= a and b <= hi) for a, b in spans):
                spans.append((lo, hi))
                valid += g["role"].tolist()
    good = roles[~roles["bad"]]
    total = {r: x - y for r, x, y in zip(good["role"], good["letters"], good["linked"], strict=True)}
    best, chosen, articles = None, "", []
    for role in good["role"][good["role"].isin(valid)]:
        name = role.rsplit("/", 1)[-1].split(".")
        if name[0] not in CONTAINERS or name[0] == "html":
            continue
        if name[0] == "article":
            articles.append(role)
        plain = sum(x for r, x in total.items() if r == role or r.startswith(role + "/"))
        named = 3 if name[0] == "article" else 2 if name[0] == "main" else 1 if not ARTICLE.isdisjoint(name[1:]) else 0
        rank = (plain * (1 + named) / (1 + 0.05 * sum(total.values()) * (name[0] == "body" and not named)), named, -role.count("/"))
        if best is None or rank > best:
            best, chosen = rank, role
    slots = [chosen, *(r for r in articles if r != chosen and chosen in articles)] if chosen else []
    texts = [r for r in valid if r[0] == "#"]
    return pd.DataFrame({"host": [roles["host"].iloc[0]], "slot": [chosen], "roles": [len(valid) - len(texts)], "slots": [slots], "texts": [texts]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, roles, slots, texts, named) for each host whose pages share any tokens, and for all pages together as host *.

    named: the roles with a name of boilerplate that at least SUPPORT of the host's pages have.

    Text that copies of a page share is no evidence: of a token's pages, as many as the host has copies are not counted.
    All pages together have no text of their own.
    """
    sums = [F.sum(c).alias(c) for c in ("v1", "v2", "first", "last", "letters", "linked")]
    tokens = profiles(pages).groupBy("host", "role").agg(F.count("*").alias("n"), *sums, F.max("bad").alias("bad"))
    by_host = materialise(tokens.where(f"n >= {SUPPORT} or (role not like '#%' and role not like '!%')"))
    named = by_host.where("role like '!%'").groupBy("host").agg(F.collect_list(F.substring("role", 2, 1 << 20)).alias("named"))
    by_host = by_host.where("role not like '!%'")
    # Places are means over the pages; a role counts where half of the pages have it.
    every = by_host.where("role not like '#%'").groupBy("role").agg(F.sum("n").alias("n"), *sums, F.max("bad").alias("bad")).select(F.lit("*").alias("host"), "*")
    rows = by_host.select(every.columns).unionByName(every)
    size = rows.where("role = ''").select("host", F.col("n").alias("pages"))
    copies = pages.groupBy("host").agg((F.count("*") - F.count_distinct(F.xxhash64("page"))).alias("copies"))
    sized = rows.where("role <> ''").join(size.join(copies, "host", "left"), "host").where(f"n >= {SUPPORT} and 2 * n >= pages")
    often = sized.where(f"role not like '#%' or (n - copies >= {SUPPORT} and 2 * (n - copies) >= pages - copies)").select("host", "role", "n", "v1", "v2", (F.col("first") / F.col("n")).alias("first"), (F.col("last") / F.col("n")).alias("last"), "letters", "linked", "bad")
    return often.groupBy("host").applyInPandas(_template, "host string, slot string, roles int, slots array<string>, texts array<string>").join(named, "host", "left")


def article(page: str, slots: list[str], general: list[str], texts: set[str], named: set[str] | None) -> str:
    """The text of the slots that the page has, its host's or else the general ones, without the template's own text.

    Blocks with a name of boilerplate are left out, those of a name in doubt if their role is in named, or all of them if
    that is None; where nothing is left then, the page's text is under such names, and they count for nothing.
    If one is an article, or none is less than the body, all articles of the page are; without these main or body or all.
    """
    seen = list(events(page))
    return _read(seen, slots, general, texts, lambda n: n.bad or n.sure or bool(n.named) and (named is None or not named.isdisjoint(n.named))) or _read(seen, slots, general, texts, lambda n: n.bad)


def _read(seen: list[tuple[str, Node, str]], slots: list[str], general: list[str], texts: set[str], out: Callable[[Node], bool]) -> str:
    opened = {n.role for k, n, _ in seen if k == "open"}
    tags: dict[str, list[str]] = {}
    for k, n, _ in seen:
        if k == "open" and n.tag in ("article", "main", "body") and not out(n):
            tags.setdefault(n.tag, []).append(n.role)
    tagged = next((tags[t] for t in ("article", "main", "body") if t in tags), [""])
    tag = lambda s: s.rsplit("/", 1)[-1].split(".")[0]
    inside = next((x for x in ([s for s in among if s in opened and tag(s) != "body"] for among in (slots, general)) if x), tagged)
    if any(tag(s) == "article" for s in inside):
        inside = [*inside, *tags.get("article", ())]
    slot, under = set(inside), tuple(s + "/" for s in inside)
    whole = "" in slot
    belongs = lambda n: not out(n) and (whole or n.role in slot or n.role.startswith(under))
    blocks, run, at = [], [], ""

    def end() -> None:
        raw = "".join(run)
        if not texts or _token(at, raw) not in texts:
            blocks.append(raw)
        run.clear()

    for kind, node, raw in seen:
        if kind == "text":
            if belongs(node):
                run.append(raw)
                at = node.role
        elif kind == "break" or node.tag in BLOCKS:
            end()
        elif node.tag == "br":
            run.append(" ")
    end()
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, slot) for every row of pages.

    A null or empty page has an empty text; a null or malformed address counts as a host of its own name, empty; null
    keys are carried along; repeated rows give repeated rows; an empty table gives an empty table; other columns are
    not read. Pages of any length are read whole.
    """
    kind = pages.schema[key].dataType.simpleString()
    host = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    read = pages.select(host.alias("host"), F.concat_ws("|", F.col(key).cast("string"), F.col(url)).alias("name"), F.col(page).alias("page"))
    made = materialise(templates(read))
    size = made.agg(F.sum(F.length("host") + F.length(F.concat_ws(" ", "slots", "texts", "named")) + 64)).first()[0] or 0
    general = made.where("host = '*'").select("slots").first()
    general = list(general[0]) if general else []
    own = made.where("host <> '*'").select(F.col("host").alias("_host"), F.col("slot").alias("_slot"), F.col("slots").alias("_slots"), F.col("texts").alias("_texts"), F.coalesce("named", F.array()).alias("_named"))
    own = F.broadcast(own) if size <= BROADCAST_BYTES else own
    joined = pages.select(key, url, page).withColumn("_at", host).join(own, F.col("_at") == F.col("_host"), "left").select(key, url, page, "_slot", "_slots", "_texts", "_named")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                texts = [article(x or "", slots or [], general, set(own or ()), None if named is None else set(named)) for x, slots, own, named in zip(*(b.column(k).to_pylist() for k in (2, 4, 5, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)], [key, url, "text", "n_chars", "slot"])

    return joined.mapInArrow(run, f"{key} {kind}, {url} string, text string, n_chars long, slot string")
