"""Pages, links, hosts, mail and model output: what is read from text, and what is chosen among it.

Addresses are taken apart by patterns and put together as browsers do. Tags are found by patterns as
well, so an element nested in one of its own name ends at the first end tag; ``functions.markup`` reads
pages by a parser.
"""

from __future__ import annotations

import sys
import unicodedata

from gnomon.plans.schedule import VISIBLE

# ---- hosts and addresses ----
ORIGIN = "regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
HOST = "lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
PATH = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1)"


def absolute(href: str, base: str) -> str:
    """``href`` as found on a page at ``base``: joined, without ``.`` and ``..``, scheme and host in lower case, a default port left out, an empty path as /."""
    return canonical(joined(href, base))


def joined(href: str, base: str) -> str:
    origin, path = ORIGIN.format(u=base), PATH.format(u=base)
    folder = f"regexp_extract({path}, '^(.*/)', 1)"
    same = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1)"
    return f"""CASE WHEN @matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {href} WHEN @matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN @matches({href}, '^(?i)https?:') AND lower(regexp_extract({href}, '^([a-zA-Z]+:)', 1)) = lower({same}) THEN concat({origin}, coalesce(nullif({folder}, ''), '/'), regexp_extract({href}, '^[^:]*:(.*)$', 1)) ELSE {href} END
  WHEN {href} LIKE '//%' THEN concat({same}, {href}) WHEN {href} LIKE '/%' THEN concat({origin}, {href}) WHEN {href} = '' THEN regexp_extract({base}, '^([^#]*)', 1) WHEN {href} LIKE '#%' THEN concat(regexp_extract({base}, '^([^#]*)', 1), {href})
  WHEN {href} LIKE '?%' THEN concat({origin}, {path}, {href}) ELSE concat({origin}, coalesce(nullif({folder}, ''), '/'), {href}) END"""


SEGMENTS = "@split(regexp_extract(u, '^[^?#]*?//[^/?#]*/?([^?#]*)', 1), '/')"


def canonical(url: str) -> str:
    """An address with a scheme and a host in the one form that stands for it; other texts stay as they are."""
    return f"@get(@transform(@list({url}), u, {formed(SEGMENTS, f'@folded({SEGMENTS})')}), 1)"


def formed(segments: str, folded: str) -> str:
    """The canonical form of an address u, from its path's segments and what is left of them without . and .."""
    origin = "@replace_all(@replace_all(lower(regexp_extract(u, '^([^?#]*?//[^/?#]*)', 1)), '^(http://.*):80$', @first()), '^(https://.*):443$', @first())"
    path = f"concat('/', @join({folded}, '/'), CASE WHEN @size({folded}) > 0 AND @last({segments}) IN ('.', '..') THEN '/' ELSE '' END)"
    return f"CASE WHEN NOT @matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]') THEN u ELSE concat({origin}, {path}, regexp_extract(u, '^[^?#]*([?#].*)$', 1)) END"


def domains(rows: str, host: str) -> str:
    """CTE ``named``: ``rows`` with ``domain``, the registrable one of ``host``: a label and the longest public suffix.

    ``suffix`` has the rules of a public-suffix list, of any number of labels, with ``*.`` before rules for
    every label there and ``!`` before exceptions; a last label without a rule is a suffix as well. Each
    host's tails are looked up once. Null for a suffix itself, a bare label, an address of numbers, an empty label.
    """
    return f"""labelled AS (SELECT dom_host, labels, @size(labels) AS n, @explode(@upto(@size(labels))) AS k FROM (SELECT dom_host, @labels(dom_host) AS labels FROM (SELECT DISTINCT lower({host}) AS dom_host FROM {rows} h) WHERE dom_host IS NOT NULL AND NOT @matches(dom_host, '^[0-9.]+$|:|^[.]|[.][.]|[.]$|^$'))),
  tail AS (SELECT dom_host, labels, n, k, @join(@tail(labels, k), '.') AS tail FROM labelled),
  suffix_rule AS (SELECT DISTINCT CASE WHEN name LIKE '!%' THEN substring(name, 2) WHEN name LIKE '*.%' THEN substring(name, 3) ELSE name END AS base, CASE WHEN name LIKE '!%' THEN 2 WHEN name LIKE '*.%' THEN 1 ELSE 0 END AS kind FROM suffix),
  public_part AS (SELECT t.dom_host, t.labels, t.n, coalesce(max(CASE WHEN r.kind = 2 THEN t.k - 1 END), max(CASE WHEN r.kind = 0 THEN t.k WHEN r.kind = 1 AND t.n > t.k THEN t.k + 1 END), 1) AS public FROM tail t LEFT JOIN suffix_rule r ON r.base = t.tail GROUP BY t.dom_host, t.labels, t.n),
  named AS (SELECT h.*, CASE WHEN d.n > d.public THEN @join(@tail(d.labels, d.public + 1), '.') END AS domain FROM {rows} h LEFT JOIN public_part d ON d.dom_host = lower({host}))"""


# Host of an e-mail address (after its last @), of an address with a scheme, or the text itself.
HOST_OF = "CASE WHEN @matches(trim(lower({t})), '^.+@.') THEN @replace_all(regexp_extract(trim(lower({t})), '@([^@]*)$', 1), '[/:?#].*$', '') WHEN {t} LIKE '%://%' THEN " + HOST.format(u="trim({t})") + " ELSE @replace_all(trim(lower({t})), '[/:?#].*$', '') END"
_WEB = "CASE WHEN @matches(trim({t}), '^(?i)https?://') THEN trim({t}) ELSE concat('https://', trim({t})) END"

# ---- e-mail ----
# Hosts and paths of redirects, and suffixes of files, in the order in which they are tried.
TRACKING_HOST = r"^url\d+\.|^click\.|^track\.|^link\.|^email\.|^em\.|^e\.|^t\.|^trk\."
TRACKING_PATH = r"(?i)/ls/click|/click\?|/unsubscribe|/wf/open"
IMAGE_OR_DOC = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|bmp|pdf|zip)(\?|$)"
FORWARD_MARKER = r"(?i)(-+\s*Forwarded message\s*-+|Begin forwarded message:|________)"
_EMAIL = r"([^<>\s]+@[^<>\s]+)"

# ---- pages ----
# What names a schedule, in links, file names and pictures.
SCHEDULE_WORD = r"(?i)\b(schedule|times|minyan|davening|prayer\s*times|service\s*times|tefilla|tefillah|shacharis|shacharit|mincha|maariv|shabbos|shabbat|kabbalat\s*shabbat|davening\s*times)\b"
CLOCK = r"(?i)\b\d{1,2}:\d{2}\s*(am|pm)?\b"
PATHS = (
    "/schedule", "/schedule.html", "/times", "/calendar", "/services", "/service-times", "/prayer-times", "/service-schedule", "/minyan", "/minyan-times", "/minyanim", "/davening", "/davening-times", "/tefilla", "/tefillah",
    "/shacharis", "/shabbos", "/shabbat", "/worship/shabbat",
)
PDF_RANKS = ((r"(schedule|minyan|davening|bulletin|weekly|magazine|times|zmanim|tefilla)", 10), (r"(parsha|parashas|behar|bamidbar|vayikra|shabbos|shabbat)", 5), (r"(donation|sponsor|partner|fundrais|membership|brochure|application)", -20))
IMAGE_NEVER = r"(?i)(logo|icon|favicon|sprite|pixel|tracking|avatar|profile)"
IMAGE_RANKS = ((r"(schedule|davening|daven|minyan|bulletin|times|zmanim|tefilla)", 20), (r"(banner|hero|cover|background)", -5))
IMAGE_FILE = r"(?i)\.(jpg|jpeg|png|webp)(\?|$)"
VOLATILE = ("v", "ver", "rev", "cb", "cache", "nocache", "cachebuster", "cachebust", "_", "build", "rand")
PLATFORM_HOSTS = {"shulcloud": ("shulcloud.com", "images.shulcloud.com"), "shulspace": ("shulspace.com", "cdn.shulspace.com"), "shulhub": ("shulhub.com",), "wix": ("wixstatic.com", "wix.com", "parastorage.com")}
# Names of services and of days, in the order in which they are looked for, and clocks.
SERVICES = {
    "shacharis": r"(?i)\b(?:shacharis|shacharit|shaharit|hashkama|hashkamah|netz|vasikin|vatikin|sunrise minyan|morning service|morning minyan)\b",
    "mincha": r"(?i)\b(?:mincha|minchah|minha|afternoon service|afternoon minyan)\b",
    "maariv": r"(?i)\b(?:maariv|ma''ariv|mariv|arvit|arbit|evening service|evening minyan|night minyan)\b",
    "candles": r"(?i)\b(?:candle\s*lighting|candle\s*light|hadlakat\s*nerot|licht\s*benschen|candles?)\b",
    "havdalah": r"(?i)\b(?:havdalah|havdala)\b",
    "selichos": r"(?i)\b(?:selichos|selichot|slichos|slichot)\b",
}
DAYS = {
    "shabbos": r"(?i)\b(?:shabbos|shabbat|shabbath|saturday morning|fri(?:day)?\s*night|kabbalat\s*shabbat)\b",
    "rosh_chodesh": r"(?i)\brosh\s*chodesh\b",
    "yom_tov": r"(?i)\b(?:yom\s*tov|festival|chag|holiday)\b",
    "sunday": r"(?i)\b(?:sunday|sundays|sun\.?)\b",
    "monday": r"(?i)\b(?:monday|mondays|mon\.?)\b",
    "tuesday": r"(?i)\b(?:tuesday|tuesdays|tue\.?|tues\.?)\b",
    "wednesday": r"(?i)\b(?:wednesday|wednesdays|wed\.?)\b",
    "thursday": r"(?i)\b(?:thursday|thursdays|thu\.?|thur\.?|thurs\.?)\b",
    "friday": r"(?i)\b(?:friday|fridays|fri\.?)\b",
    "weekday": r"(?i)\b(?:weekday|weekdays|mon(?:day)?\s*[-–—to]+\s*fri(?:day)?|sun(?:day)?\s*[-–—to]+\s*fri(?:day)?|mon(?:day)?\s*[-–—to]+\s*thu(?:rsday)?)\b",
}
TIME_FIXED = r"(?i)\b(\d{1,2}):(\d{2})\s*(a\.?m\.?|p\.?m\.?)\b"
TIME_RELATIVE = r"(?i)\b(\d{1,3})\s*(?:minutes?|mins?|min)\s*(before|after|prior to|past)\s*(sunset|sunrise|netz|shkia|shkiah|plag|chatzos|chatzot)\b"
SCHEDULE_HINT = r"(?i)\bschedule|times?|minyan|davening\b"

# Elements that are cut with their bodies, then comments, then tags without bodies, one kind after the other.
CUT = [(f"<{t}", rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>") for t in ("script", "style", "noscript", "svg", "template")] + [("<!--", "(?s)<!--.*?-->")] + [(f"<{t}", rf"(?i)<{t}\b[^>]*/?>") for t in ("link", "meta", "img", "source", "input")]


def sanitized(rows: str) -> str:
    """A subquery: (page_id, html) of ``rows`` without what is cut, and without needless white space.

    Patterns are run only over pages that have the kind they cut, which a plain search tells.
    """
    out = f"(SELECT page_id, html, lower(html) AS low FROM {rows})"
    for mark, pattern in CUT:
        out = f"(SELECT page_id, low, CASE WHEN instr(low, '{mark}') > 0 THEN @replace_all(html, '{pattern}', '') ELSE html END AS html FROM {out})"
    out = f"(SELECT page_id, CASE WHEN instr(low, chr(9)) > 0 THEN translate(html, chr(9), ' ') ELSE html END AS html FROM {out})"
    return rf"(SELECT page_id, @strip(@replace_all(@replace_all(html, '  +', ' '), '[^\S\n]*\n[^\S\n]*\n\s*', concat(chr(10), chr(10)))) AS html FROM {out})"


VISIBLE_TEXT = r"@replace_all(@replace_all(@replace_all(html, '(?is)<script.*?</script>', ''), '(?is)<style.*?</style>', ''), '(?s)<[^>]+>', ' ')"
LOOKS = f"@matches({VISIBLE_TEXT}, '{SCHEDULE_WORD}') AND @size(@extract_all({VISIBLE_TEXT}, '{CLOCK}')) >= 2"


def listed(rows: str, keep: str, found: str) -> str:
    """A subquery: a row for each of the texts that ``found`` lists, with ``k`` as its place in the list."""
    return f"(SELECT {keep}, k, @get(got, k) AS tag FROM (SELECT {keep}, got, @explode(@upto(@size(got))) AS k FROM (SELECT {keep}, {found} AS got FROM {rows})))"


def attribute(name: str) -> str:
    return rf"""regexp_extract(tag, '(?i)\b{name}\s*=\s*["'']([^"'']*)["'']', 1)"""


def links(rows: str = "site") -> str:
    """CTE ``link``: of each page its links within the site that have a text, each once, in order, 200 at most."""
    return rf"""link AS (SELECT page_id, url, href, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY k) AS again FROM
  (SELECT page_id, url, k, text, @explode(@list({absolute('raw', 'url')})) AS href FROM (SELECT page_id, url, k, trim({attribute('href')}) AS raw, trim(@replace_all(@replace_all(tag, '(?s)<[^>]*>', ''), '\s+', ' ')) AS text FROM {listed(rows, 'page_id, url', r"@extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>')")})
    WHERE raw <> '' AND NOT @matches(raw, '^(#|mailto:|tel:|javascript:)')) WHERE {ORIGIN.format(u='href')} = {ORIGIN.format(u='url')}) WHERE again = 1 AND text <> ''),
  shown AS (SELECT * FROM link WHERE nth <= 200)"""


def _rank(text: str, ranks: tuple) -> str:
    return " + ".join(f"CASE WHEN @matches({text}, '{p}') THEN {n} ELSE 0 END" for p, n in ranks)


def resource_key(url: str) -> str:
    """An address without what changes from load to load: known names, and values of 16 or more hexadecimal digits."""
    query = f"regexp_extract({url}, '^[^?#]*[?]([^#]*)', 1)"
    names = "|".join(VOLATILE)
    kept = f"@filter(@split({query}, '&'), x, x <> '' AND NOT @matches(x, '(?i)^({names})(=|$)') AND NOT @matches(x, '(?i)^[^=]*=[a-f0-9]{{16,}}$'))"
    return f"concat({ORIGIN.format(u=url)}, coalesce(nullif({PATH.format(u=url)}, ''), '/'), CASE WHEN @size({kept}) = 0 THEN '' ELSE concat('?', @join({kept}, '&')) END)"


def _plain() -> tuple[dict[str, str], dict[str, str]]:
    """Letters and digits of all scripts whose compatibility decomposition, without marks, is one ASCII letter or digit; and ligatures and the like of more."""
    one, more = {}, {}
    for k in range(0x80, sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.decomposition(c):
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
            if d.isascii() and d.isalnum():
                (one if len(d) == 1 else more)[c] = d
    return one, {c: d for c, d in more.items() if unicodedata.category(c).startswith("L")}


def fold(text: str) -> str:
    """Text without marks, its letters and digits as what compatibility decomposition leaves of them in ASCII; put in lower case before, not after."""
    one, more = _plain()
    text = f"translate({text}, '{''.join(one)}', '{''.join(one.values())}')"
    for c, d in more.items():
        text = f"replace({text}, '{c}', '{d}')"
    return f"@replace_all({text}, '[\u0300-\u036f]', '')"


def slug(text: str) -> str:
    return f"substring(@replace_all(@replace_all({fold(f'lower({text})')}, '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 100)"


def private_address(ip: str) -> str:
    """Addresses that are not to be fetched: local, private, shared, malformed ones; of version 6 by prefix."""
    v4 = f"@replace_all(lower({ip}), '^::ffff:([0-9]+[.])', @first())"
    part = lambda k: f"CAST(split_part({v4}, '.', {k}) AS INT)"
    is4 = f"@matches({v4}, '^[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}$')"
    return f"""CASE WHEN {is4} THEN greatest({part(1)}, {part(2)}, {part(3)}, {part(4)}) > 255 OR {_private(part)}
  ELSE @matches(lower({ip}), '^(::1?$|fe80:|fec0:|fc|fd)') END"""


def _private(part) -> str:
    return f"{part(1)} IN (0, 10, 127) OR ({part(1)} = 169 AND {part(2)} = 254) OR ({part(1)} = 172 AND {part(2)} BETWEEN 16 AND 31) OR ({part(1)} = 192 AND {part(2)} = 168) OR ({part(1)} = 100 AND {part(2)} BETWEEN 64 AND 127)"


LOCAL_HOST = r"(^|\.)(localhost)$|\.(local|internal)$"


def blocked_host(host: str) -> str:
    """The edge's rule for host names: local names, private numbers, and version 6 prefixes only where there is a colon."""
    h = f"@replace_all(lower({host}), '^\\[|\\]$', '')"
    part = lambda k: f"CAST(split_part({h}, '.', {k}) AS INT)"
    return f"""CASE WHEN @matches({h}, '{LOCAL_HOST}') THEN true WHEN {h} LIKE '%:%' THEN @matches({h}, '^(::1?$|fe80:|fc|fd)') WHEN @matches({h}, '^[0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}$') THEN {_private(part)} ELSE false END"""


def extract_lines(rows: str) -> str:
    """CTE ``extracted``: services found in ``rows`` (page_id, line_no, line), each once a page, with their confidence and order.

    A line needs a clock with AM or PM or minutes before or after a time of the sun; the service, and
    the day, may stand in the lines beside it.
    """
    service = "CASE " + " ".join(f"WHEN @matches(around, '{p}') THEN '{n}'" for n, p in SERVICES.items()) + " END"
    day = "CASE " + " ".join(f"WHEN @matches(around, '{p}') THEN '{n}'" for n, p in DAYS.items()) + " ELSE 'weekday' END"
    in_line = lambda column, table: f"CASE {column} " + " ".join(f"WHEN '{n}' THEN @matches(line, '{p}')" for n, p in table.items()) + " ELSE false END"
    rank = "CASE service " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(SERVICES)) + " ELSE 6 END"
    ref = f"lower(regexp_extract(line, '{TIME_RELATIVE}', 3))"
    hour = f"CAST(regexp_extract(line, '{TIME_FIXED}', 1) AS INT)"
    return f"""listed AS (SELECT page_id, line_no, line, concat_ws(' | ', lag(line) OVER w, line, lead(line) OVER w) AS around FROM (SELECT page_id, line_no, trim(@replace_all(line, '[ \\t]+', ' ')) AS line FROM {rows}) WHERE @len(line) BETWEEN 1 AND 239 WINDOW w AS (PARTITION BY page_id ORDER BY line_no)),
  timed_line AS (SELECT *, @matches(line, '{TIME_RELATIVE}') AS relative, {service} AS service, {day} AS day_rule FROM listed WHERE @matches(line, '{TIME_FIXED}') OR @matches(line, '{TIME_RELATIVE}')),
  read_line AS (SELECT page_id, line_no, line, around, relative, service, day_rule,
    CASE WHEN NOT relative THEN 'fixed' WHEN @matches({ref}, 'sunrise|netz') THEN 'relative_sunrise' WHEN @matches({ref}, 'plag') THEN 'relative_plag' WHEN @matches({ref}, 'chatz') THEN 'relative_chatzos' ELSE 'relative_sunset' END AS time_kind,
    CASE WHEN relative THEN CAST(regexp_extract(line, '{TIME_RELATIVE}', 1) AS INT) * CASE WHEN @matches(regexp_extract(line, '{TIME_RELATIVE}', 2), '(?i)before|prior') THEN -1 ELSE 1 END END AS offset_min,
    CASE WHEN NOT relative THEN concat(lpad(CAST(CASE WHEN @matches(regexp_extract(line, '{TIME_FIXED}', 3), '(?i)p') THEN CASE WHEN {hour} = 12 THEN 12 ELSE {hour} + 12 END WHEN {hour} = 12 THEN 0 ELSE {hour} END AS VARCHAR(3)), 2, '0'), ':', regexp_extract(line, '{TIME_FIXED}', 2)) END AS clock FROM timed_line WHERE service IS NOT NULL),
  scored AS (SELECT *, (40 + CASE WHEN {in_line('service', SERVICES)} THEN 20 ELSE 0 END + CASE WHEN {in_line('day_rule', DAYS)} THEN 15 ELSE 0 END + CASE WHEN @len(line) < 80 THEN 10 ELSE 0 END + CASE WHEN relative THEN 5 ELSE 0 END + CASE WHEN @matches(around, '{SCHEDULE_HINT}') THEN 5 ELSE 0 END) / 100e0 AS confidence FROM read_line),
  extracted AS (SELECT page_id, service, day_rule, time_kind, clock, offset_min, line, confidence, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {rank}, day_rule, first_no) AS BIGINT) AS nth FROM
    (SELECT *, row_number() OVER (PARTITION BY page_id, service, day_rule, time_kind, clock, offset_min ORDER BY confidence DESC, line_no) AS rn, min(line_no) OVER (PARTITION BY page_id, service, day_rule, time_kind, clock, offset_min) AS first_no FROM scored) WHERE rn = 1)"""


def fuzzy(rows: str, needle: str) -> str:
    """CTE ``fuzzy``: ``rows`` (id, name, address) with the score of ``needle``, an expression for a lower-case text, as characters in order.

    Each character is looked for behind the one before it, in one walk over the needle's characters of
    any number. State: place of the last one found (below 0 once one is not), of the first, run of neighbours, sum.
    """
    found = "s.p + instr(substring(hay, CAST(s.p AS INT) + 1), x.c)"
    next_ = "instr(substring(hay, CAST(s.p AS INT) + 1), x.c)"
    near = f"s.p0 > 0 AND {next_} = 1"
    run = f"CASE WHEN {near} THEN s.run + 1 ELSE 0 END"
    more = f"10 + CASE WHEN {near} THEN 10 + 2 * (s.run + 1) ELSE 0 END + CASE WHEN {found} = 1 OR @matches(substring(hay, CAST({found} AS INT) - 1, 1), '\\s') THEN 15 ELSE 0 END"
    big = lambda e: f"CAST({e} AS BIGINT)"
    state = lambda p, p0, run, walk: f"@struct(p, {big(p)}, p0, {big(p0)}, run, {big(run)}, walk, {big(walk)}, c, x.c)"
    step = f"CASE WHEN s.p < 0 OR {next_} = 0 THEN {state('-1', 's.p0', '0', '0')} ELSE {state(found, f'CASE WHEN s.p0 = 0 THEN {found} ELSE s.p0 END', run, f's.walk + {more}')} END"
    chars = f"@transform(@chars({needle}), ch, @struct(p, {big('0')}, p0, {big('0')}, run, {big('0')}, walk, {big('0')}, c, ch))"
    start = f"@struct(p, {big('0')}, p0, {big('0')}, run, {big('0')}, walk, {big('0')}, c, '')"
    boost = f"CASE WHEN instr(low_name, {needle}) > 0 THEN 200 + CASE WHEN instr(low_name, {needle}) = 1 THEN 100 ELSE 0 END WHEN instr(hay, {needle}) > 0 THEN 50 ELSE 0 END"
    score = f"CASE WHEN w.p <= 0 THEN 0 ELSE CAST(w.walk - least(w.p0 - 1, 30) + {boost} AS BIGINT) END"
    # lists of one keep a filter on the score from being pushed down through the walk, where it would repeat it
    return f"""fz AS (SELECT id, name, address, lower(name) AS low_name, lower(concat(name, ' ', coalesce(address, ''))) AS hay FROM {rows}),
  fzw AS (SELECT *, @explode(@list(@walk({chars}, {start}, s, x, {step}))) AS w FROM fz),
  fuzzy AS (SELECT id, name, address, @explode(@list({score})) AS score FROM fzw)"""


PLACE_TYPES = (("synagogue", 0.4), ("place_of_worship", 0.25), ("religious_organization", 0.15))
# The share of a name's longer words that a hit's name has, more for its kind and for a word of the host.
PLACE_MATCH = """hit AS (SELECT h.*, @filter(@split(@replace_all(lower(wanted), '[^a-z0-9 ]', ' '), ' '), x, @len(x) > 2) AS tokens, @filter(@split(@replace_all(@replace_all(host, '[.][^.]*$', ''), '[._]', '-'), '-'), x, @len(x) > 3) AS hints, lower(name) AS low_name, lower(concat(name, ' ', address)) AS hay FROM place_hit h WHERE name IS NOT NULL AND address IS NOT NULL),
  alike AS (SELECT *, CASE WHEN @size(tokens) = 0 THEN 0e0 ELSE CAST(@size(@filter(tokens, x, instr(low_name, x) > 0)) AS DOUBLE) / @size(tokens) END AS sim FROM hit),
  judged AS (SELECT *, round(least(1e0, sim * 0.7e0 + CASE WHEN @has(types, 'synagogue') THEN 0.4e0 WHEN @has(types, 'place_of_worship') THEN 0.25e0 WHEN @has(types, 'religious_organization') THEN 0.15e0 ELSE 0e0 END
    + CASE WHEN @size(@filter(hints, x, instr(hay, x) > 0)) > 0 THEN 0.15e0 ELSE 0e0 END), 9) AS confidence FROM alike WHERE sim >= 0.3e0)"""
LOCALITY = ("neighborhood", "sublocality", "sublocality_level_1", "locality", "postal_town")

_FAILED = "CASE WHEN status = 'extracted' THEN concat(strategy, ' ', CAST(rules AS VARCHAR(9)), 'r', CASE WHEN confidence IS NULL THEN '' ELSE concat('@', @fixed2(confidence)) END) ELSE concat(strategy, ' ', status, CASE WHEN coalesce(message, '') = '' THEN '' ELSE concat(': ', substring(@replace_all(message, '\\s+', ' '), 1, 90)) END) END"
GUARD = """confidence < 0.6e0 OR (prev >= 3 AND now < 0.5e0 * prev) OR now = 0"""
GUARD_REASON = f"""CASE WHEN NOT ({GUARD}) THEN NULL ELSE coalesce(nullif(concat_ws('; ', CASE WHEN confidence < 0.6e0 THEN concat('confidence ', @fixed2(confidence), ' < 0.6') END,
  CASE WHEN prev >= 3 AND now < 0.5e0 * prev THEN concat('rule count dropped from ', CAST(prev AS VARCHAR(9)), ' → ', CAST(now AS VARCHAR(9)), ' (>50% drop)') END,
  CASE WHEN now = 0 AND prev > 0 THEN concat('new extraction produced 0 rules (previous: ', CAST(prev AS VARCHAR(9)), ')') END), ''), 'broken (unknown reason)') END"""

_SENDER_LINES = listed("mail", "id, body", r"@extract_all(CASE WHEN @matches(body, '" + FORWARD_MARKER + r"') THEN substring(body, instr(body, regexp_extract(body, '" + FORWARD_MARKER + r"', 1))) ELSE body END, '(?im)^From:\s*.+$')")
_SENDER = rf"""sender AS (SELECT id, k, CASE WHEN @matches(line, '^\s*""?[^""<]+?""?\s*<\s*[^>\s]+@[^>\s]+\s*>\s*$') THEN lower(regexp_extract(line, '<\s*([^>\s]+@[^>\s]+)\s*>', 1)) WHEN @matches(line, '^{_EMAIL}$') THEN lower(line) END AS email,
  CASE WHEN @matches(line, '^\s*""?[^""<]+?""?\s*<') THEN trim(regexp_extract(line, '^\s*""?([^""<]+?)""?\s*<', 1)) END AS name FROM (SELECT id, k, @strip(@replace_all(tag, '(?i)^From:\s*', '')) AS line FROM {_SENDER_LINES}))""".replace('""', '"')
_CLEAN_SITE = r"@replace_all(tag, '[.,;:!?>)\]\s]+$', '')"
_BODY_LINKS = listed("mail", "id, body", r"""@extract_all(body, '(?i)https?://[^\s"''<>)\]]+')""")
_LOW = "lower(html)"

TEXT = {
    "page_hash": f"SELECT page_id, @sha256(substring(html, 1, 120000)) AS hash FROM {sanitized('site')}",
    "page_links": f"WITH {links()} SELECT page_id, href, text, nth FROM shown",
    "looks_like_schedule": f"SELECT page_id, {LOOKS} AS looks FROM site",
    "schedule_url": f"""WITH {links()}, home AS (SELECT id, submitted_url AS url, CASE WHEN {HOST.format(u="coalesce(submitted_url, '')")} = '' THEN '' ELSE {ORIGIN.format(u='submitted_url')} END AS origin FROM root),
  tried AS (SELECT h.id, s.url, row_number() OVER (PARTITION BY h.id ORDER BY g.rank) AS rn FROM home h CROSS JOIN (VALUES {", ".join(f"({k}, '{p}')" for k, p in enumerate(PATHS))}) AS g(rank, path) JOIN site s ON s.url = concat(h.origin, g.path) WHERE h.origin <> '' AND {LOOKS}),
  scanned AS (SELECT h.id, l.href, l.text, row_number() OVER (PARTITION BY h.id ORDER BY l.page_id, l.nth) AS rn FROM home h JOIN shown l ON l.url = concat(h.origin, '/') WHERE @matches(lower(l.text), '{SCHEDULE_WORD}') OR @matches(lower({PATH.format(u='l.href')}), '{SCHEDULE_WORD}'))
  SELECT h.id, CASE WHEN h.origin = '' OR @len({PATH.format(u='h.url')}) > 1 THEN h.url ELSE coalesce(t.url, c.href, h.url) END AS url, CASE WHEN h.origin = '' OR @len({PATH.format(u='h.url')}) > 1 THEN 'root' WHEN t.url IS NOT NULL THEN 'pattern' WHEN c.href IS NOT NULL THEN 'page-link' ELSE 'root' END AS via,
    CASE WHEN h.origin = '' THEN 0e0 WHEN @len({PATH.format(u='h.url')}) > 1 THEN 1e0 WHEN t.url IS NOT NULL THEN 0.85e0 WHEN c.href IS NOT NULL THEN 0.75e0 ELSE 0.4e0 END AS confidence
  FROM home h LEFT JOIN tried t ON t.id = h.id AND t.rn = 1 LEFT JOIN scanned c ON c.id = h.id AND c.rn = 1""",
    "pdf_candidates": rf"""WITH found AS (SELECT page_id, k, {absolute('href', 'url')} AS link FROM (SELECT page_id, url, k, {attribute('href')} AS href FROM {listed('site', 'page_id, url', r'''@extract_all(html, '(?i)href=["'']([^"'']+\.pdf(?:\?[^"'']*)?)["'']')''')})),
  ranked AS (SELECT page_id, link, min(k) AS k, max({_rank('lower(link)', PDF_RANKS)}) AS rank FROM found GROUP BY page_id, link)
  SELECT page_id, link, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, k) AS rn FROM ranked) WHERE rn = 1""",
    "image_candidates": rf"""WITH tags AS (SELECT page_id, url, k, src, lower(concat(src, ' ', {attribute('alt')}, ' ', {attribute('id')}, ' ', {attribute('class')})) AS words FROM (SELECT *, {attribute('src')} AS src FROM {listed('site', 'page_id, url', r"@extract_all(html, '(?i)<img\b[^>]*>')")})),
  ranked AS (SELECT page_id, {absolute('src', 'url')} AS link, k, {_rank('words', IMAGE_RANKS)} + CASE WHEN @matches(src, '{IMAGE_FILE}') THEN 2 ELSE 0 END AS rank FROM tags WHERE src <> '' AND NOT src LIKE 'data:%' AND NOT @matches(src, '{IMAGE_NEVER}')),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY k) AS again FROM ranked) WHERE again = 1 AND rank > 0)
  SELECT page_id, link, rank, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, k) AS BIGINT) AS nth FROM once) WHERE nth <= 3""",
    "resource_key": f"SELECT page_id, url, {resource_key('url')} AS resource FROM site",
    "resource_unchanged": f"""WITH now AS (SELECT page_id % 500 AS source_id, {resource_key('url')} AS resource FROM site), had AS (SELECT s.id, s.run_status, {resource_key("coalesce(@json(s.config_json, '$.last_extracted_resource'), '')")} AS resource FROM source s WHERE @json(s.config_json, '$.last_extracted_resource') IS NOT NULL)
  SELECT h.id, count(n.resource) > 0 AND coalesce(h.run_status IN ('ok', 'no_change'), false) AS unchanged FROM had h LEFT JOIN now n ON n.source_id = h.id % 500 AND n.resource = h.resource GROUP BY h.id, h.run_status""",
    "platform": rf"""WITH host AS (SELECT page_id, {HOST.format(u="concat('https:', @replace_all(src, '^[a-zA-Z]+:', ''))")} AS host FROM (SELECT page_id, regexp_extract(tag, '(?i)\b(?:src|href)\s*=\s*["'']([^"'']*)["'']', 1) AS src FROM {listed('site', 'page_id', r"@extract_all(html, '(?i)<(?:script|link|img|a)\b[^>]*>')")}) WHERE @matches(src, '^([a-zA-Z]+:)?//')),
  bag AS (SELECT page_id, {", ".join(f"max(CASE WHEN host IN ({', '.join(repr(x) for x in hosts)}) THEN 2 ELSE 0 END) AS {n}" for n, hosts in PLATFORM_HOSTS.items())} FROM host GROUP BY page_id),
  score AS (SELECT s.page_id, coalesce(b.shulcloud, 0) + CASE WHEN {_LOW} LIKE '%powered by shulcloud%' THEN 3 ELSE 0 END + CASE WHEN @matches(lower(s.url), '[.]shulcloud[.]com') THEN 3 ELSE 0 END + CASE WHEN @matches(html, '(?i)<meta\b[^>]*name=["'']generator["''][^>]*content=["''][^"'']*shulcloud') THEN 2 ELSE 0 END AS shulcloud,
    coalesce(b.shulspace, 0) + CASE WHEN {_LOW} LIKE '%powered by shulspace%' THEN 3 ELSE 0 END AS shulspace, coalesce(b.shulhub, 0) + CASE WHEN {_LOW} LIKE '%powered by shulhub%' THEN 3 ELSE 0 END AS shulhub,
    coalesce(b.wix, 0) + CASE WHEN @matches(html, '(?i)<meta\b[^>]*name=["'']generator["''][^>]*content=["''][^"'']*wix') THEN 2 ELSE 0 END AS wix FROM site s LEFT JOIN bag b ON b.page_id = s.page_id),
  top AS (SELECT *, greatest(shulcloud, shulspace, shulhub, wix) AS score FROM score)
  SELECT page_id, CASE WHEN score < 2 THEN 'unknown' WHEN shulcloud = score THEN 'shulcloud' WHEN shulspace = score THEN 'shulspace' WHEN shulhub = score THEN 'shulhub' ELSE 'wix' END AS platform, CASE WHEN score < 2 THEN 0e0 ELSE least(1e0, score / 5e0) END AS confidence FROM top""",
    "extracted_lines": f"WITH {extract_lines('listing')} SELECT * FROM extracted",
    "extraction_confidence": f"WITH {extract_lines('listing')} SELECT page_id, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM extracted GROUP BY page_id",
    "fuzzy_lookup": f"WITH {VISIBLE}, {fuzzy('(SELECT id, name, address FROM visible)', "'cst 12 ma'")} SELECT id, name, score FROM fuzzy WHERE score > 0 ORDER BY score DESC, name, id LIMIT 12",
    "fuzzy_scores": f"WITH {fuzzy('(SELECT id, name, address FROM place)', "'main 7'")} SELECT id, score FROM fuzzy",
    "place_match": f"WITH {PLACE_MATCH} SELECT place_id, name, address, confidence, confidence >= 0.7e0 AS applies FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY confidence DESC, pos) AS rn FROM judged) WHERE rn = 1",
    "reverse_geocode": f"""WITH part AS (SELECT *, {" OR ".join(f"@has(types, '{x}')" for x in LOCALITY)} AS local, @has(types, 'administrative_area_level_1') AS admin FROM geo_part),
  l AS (SELECT place_id, long_name FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY result_no, part_no) AS rn FROM part WHERE local) WHERE rn = 1), a AS (SELECT place_id, short_name FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY result_no, part_no) AS rn FROM part WHERE admin) WHERE rn = 1)
  SELECT coalesce(l.place_id, a.place_id) AS place_id, concat_ws(', ', l.long_name, a.short_name) AS label FROM l FULL JOIN a ON a.place_id = l.place_id""",
    "registrable_domain": f"WITH h AS (SELECT id, submitted_url, host FROM (SELECT id, submitted_url, {HOST_OF.format(t='submitted_url')} AS host FROM root WHERE submitted_url IS NOT NULL)), {domains('h', 'h.host')} SELECT id, submitted_url, domain FROM named",
    "shared_domain_places": "SELECT id FROM place p WHERE EXISTS (SELECT 1 FROM shared_domain d WHERE d.domain = lower(p.match_domain))",
    "website_normal": f"WITH h AS (SELECT id, {HOST.format(u=_WEB.format(t='submitted_url'))} AS host FROM root WHERE trim(coalesce(submitted_url, '')) <> ''), {domains('h', 'h.host')} SELECT r.id, CASE WHEN n.domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shared_domain d WHERE d.domain = n.domain) THEN concat('https://', n.host) END AS website FROM root r LEFT JOIN named n ON n.id = r.id",
    "website_in_email": f"""WITH h AS (SELECT id, k, {HOST.format(u='site')} AS host FROM (SELECT id, k, {_CLEAN_SITE} AS site FROM {_BODY_LINKS}) WHERE NOT @matches({HOST.format(u='site')}, '{TRACKING_HOST}') AND NOT @matches({PATH.format(u='site')}, '{TRACKING_PATH}') AND NOT @matches({PATH.format(u='site')}, '{IMAGE_OR_DOC}')), {domains('h', 'h.host')},
  ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM named n WHERE domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shared_domain d WHERE d.domain = n.domain)) SELECT id, concat('https://', host) AS website FROM ok WHERE rn = 1""",
    "original_sender": f"WITH {_SENDER} SELECT id, email, nullif(name, '') AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM sender WHERE email IS NOT NULL) WHERE rn = 1",
    "domain_backfill": f"""WITH mailed AS (SELECT place_id, identifier FROM (SELECT place_id, identifier, row_number() OVER (PARTITION BY place_id ORDER BY id) AS rn FROM source WHERE kind = 'email_newsletter') WHERE rn = 1),
  h AS (SELECT p.id, 1 AS turn, {HOST_OF.format(t='p.submitted_url')} AS host FROM place p WHERE p.submitted_url IS NOT NULL UNION ALL SELECT p.id, 2, {HOST_OF.format(t="(CASE WHEN m.identifier LIKE '%::%' THEN split_part(m.identifier, '::', 2) ELSE m.identifier END)")} FROM place p JOIN mailed m ON m.place_id = p.id), {domains('h', 'h.host')},
  ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS rn FROM named n WHERE domain IS NOT NULL AND (turn = 1 OR NOT EXISTS (SELECT 1 FROM shared_domain d WHERE d.domain = n.domain)))
  SELECT p.id, o.domain AS match_domain, CASE o.turn WHEN 1 THEN 'submitted_url' WHEN 2 THEN 'email_data_source' END AS source FROM place p LEFT JOIN ok o ON o.id = p.id AND o.rn = 1""",
    "duplicate_domain": f"""WITH host AS (SELECT id, @replace_all(host, '^www\\.', '') AS host FROM candidate), {domains('host', 'h.host')}, tails AS (SELECT id, host AS domain FROM host UNION SELECT id, domain FROM named WHERE domain IS NOT NULL),
  m AS (SELECT t.id, min(p.id) AS place_id FROM tails t JOIN place p ON p.match_domain = t.domain GROUP BY t.id) SELECT h.id, h.host, m.place_id FROM host h LEFT JOIN m ON m.id = h.id""",
    "private_hosts": f"SELECT ip, {private_address('ip')} AS refused, {blocked_host('ip')} AS blocked FROM ip_address",
    "local_names": f"SELECT DISTINCT host, @matches(lower(host), '{LOCAL_HOST}') AS refused, {blocked_host('host')} AS blocked FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'localhost' WHEN 1 THEN 'a.Internal' WHEN 2 THEN 'fda.gov' WHEN 3 THEN '[fd00::1]' ELSE {HOST.format(u='url')} END AS host FROM pages)",
    "mime_kind": """SELECT DISTINCT header, url, CASE WHEN @matches(lower(header), 'image/(jpeg|jpg)') THEN 'image/jpeg' WHEN lower(header) LIKE '%image/png%' THEN 'image/png' WHEN lower(header) LIKE '%image/gif%' THEN 'image/gif' WHEN lower(header) LIKE '%image/webp%' THEN 'image/webp'
  WHEN @matches(file, '[.]jpe?g$') THEN 'image/jpeg' WHEN file LIKE '%.png' THEN 'image/png' WHEN file LIKE '%.gif' THEN 'image/gif' WHEN file LIKE '%.webp' THEN 'image/webp' END AS mime
  FROM (SELECT header, url, lower(split_part(url, '?', 1)) AS file FROM (SELECT coalesce(CASE page_id % 4 WHEN 0 THEN 'image/JPG; q=1' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'application/octet-stream' END, '') AS header, concat(url, CASE page_id % 3 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b.jpeg?x=1' ELSE '/c' END) AS url FROM pages))""",
    "url_normal": rf"SELECT page_id, @replace_all(@replace_all(CASE WHEN @matches(u, '^(?i)https?://') THEN u ELSE concat('https://', u) END, '[?#].*$', ''), '/$', '') AS url FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN @replace_all(url, '^https?://', '') ELSE url END AS u FROM pages)",
    "slug": f"SELECT id, {slug('name')} AS slug FROM (SELECT id, CASE id % 4 WHEN 0 THEN concat(name, ' Bét Ël -- Ñorth') WHEN 1 THEN concat('  ', name, ' ') ELSE name END AS name FROM place)",
    "unique_slugs": r"""WITH wanted AS (SELECT id, concat('place-', CAST(id % 40 AS VARCHAR(9))) AS base FROM place WHERE id % 2 = 0), taken AS (SELECT DISTINCT concat('place-', CAST(id % 50 AS VARCHAR(9)), CASE id % 6 WHEN 1 THEN '' WHEN 3 THEN '-2' ELSE '-4' END) AS slug FROM place WHERE id % 2 = 1),
  turn AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS want FROM wanted),
  near AS (SELECT base, count(*) AS n FROM (SELECT slug AS base FROM taken UNION ALL SELECT @replace_all(slug, '-[0-9]+$', '') AS base FROM taken) GROUP BY base),
  name AS (SELECT base, n, CASE WHEN n = 1 THEN base ELSE concat(base, '-', CAST(n AS VARCHAR(3))) END AS slug FROM (SELECT w.base, @explode(@upto(least(99, w.n + coalesce(t.n, 0)))) AS n FROM (SELECT base, count(*) AS n FROM wanted GROUP BY base) w LEFT JOIN near t ON t.base = w.base)),
  free AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n) AS want FROM name f WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.slug = f.slug))
  SELECT t.id, t.base, coalesce(f.slug, concat(t.base, '-99')) AS slug FROM turn t LEFT JOIN free f ON f.base = t.base AND f.want = t.want""",
    "failure_summary": f"""SELECT source_id, substring(@join(@sorted_pairs(parts), ' | '), 1, 240) AS summary FROM (SELECT source_id, @collect_pairs(CASE WHEN strategy = preferred THEN 0 ELSE pos END, {_FAILED}) AS parts FROM attempt GROUP BY source_id)""",
    "useful": "SELECT source_id, pos, rules > 0 AND coalesce(confidence, 0e0) >= 0.4e0 AS useful, rules > 0 AND coalesce(confidence, 0e0) >= 0.6e0 AS good_enough FROM attempt",
    "cascade_winner": """SELECT a.source_id, CAST(count(*) AS BIGINT) AS attempts, min(CASE WHEN useful THEN strategy_at END) AS winner FROM (SELECT source_id, pos, rules > 0 AND coalesce(confidence, 0e0) >= 0.4e0 AS useful, concat(CAST(pos AS VARCHAR(2)), ':', strategy) AS strategy_at, min(CASE WHEN rules > 0 AND coalesce(confidence, 0e0) >= 0.4e0 THEN pos END) OVER (PARTITION BY source_id) AS won
  FROM attempt WHERE preferred IS NULL OR strategy = preferred) a WHERE won IS NULL OR pos <= won GROUP BY a.source_id""",
    "guardrail": f"SELECT source_id, prev, now, confidence, {GUARD} AS is_broken, {GUARD_REASON} AS reason FROM run_result",
    "escalation": """SELECT id, CASE WHEN cheap >= 0.4e0 THEN 'cheap' WHEN cheap_rules = 0 AND cheap < 0.2e0 THEN 'cheap' WHEN strong > cheap THEN 'strong' ELSE 'cheap' END AS winner, NOT (cheap >= 0.4e0 OR (cheap_rules = 0 AND cheap < 0.2e0)) AS escalated
  FROM (SELECT source_id AS id, cheap, cheap_rules, strong FROM model_result)""",
    "commit_buckets": r"""SELECT id, CASE WHEN @matches(lower(subject), '^feat(\(|:)') THEN 'features' WHEN @matches(lower(subject), '^fix(\(|:)') THEN 'fixes' ELSE 'notes' END AS bucket, trim(@replace_all(subject, '^(?i)[a-z]+(\([^)]+\))?:\s*', '')) AS item FROM change""",
    "next_version": r"""SELECT file, concat('v', CAST(max(CASE WHEN rn = 1 THEN CAST(regexp_extract(line, '^##\s+v(\d+)', 1) AS INT) END) + 1 AS VARCHAR(9))) AS version FROM (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rn FROM notes WHERE @matches(line, '^##\s+v\d+\s*[—-]\s*\S')) GROUP BY file""",
    "changelog": r"""WITH marked AS (SELECT file, line_no, line, CASE WHEN @matches(line, '(?i)^##\s+v\d+\s*[—-]\s*.+$') THEN 1 ELSE 0 END AS opens, CASE WHEN @matches(line, '^###\s+.+$') THEN 1 ELSE 0 END AS heads FROM notes),
  version AS (SELECT *, sum(opens) OVER (PARTITION BY file ORDER BY line_no) AS v FROM marked), section AS (SELECT *, sum(heads) OVER (PARTITION BY file, v ORDER BY line_no) AS sec FROM version WHERE v > 0),
  kind AS (SELECT *, CASE WHEN opens = 0 AND heads = 0 AND sec > 0 AND @matches(line, '^\s*[-*]\s+.+$') THEN 1 ELSE 0 END AS bullets FROM section), bullet AS (SELECT *, sum(bullets) OVER (PARTITION BY file, v, sec ORDER BY line_no) AS b FROM kind),
  named AS (SELECT *, max(CASE WHEN opens = 1 THEN lower(regexp_extract(line, '(?i)(v\d+)', 1)) END) OVER (PARTITION BY file, v) AS version, max(CASE WHEN opens = 1 THEN trim(regexp_extract(line, '(?i)^##\s+v\d+\s*[—-]\s*(.+)$', 1)) END) OVER (PARTITION BY file, v) AS day, max(CASE WHEN heads = 1 THEN trim(regexp_extract(line, '^###\s+(.+)$', 1)) END) OVER (PARTITION BY file, v, sec) AS heading FROM bullet)
  SELECT file, version, day, heading, CAST(b AS BIGINT) AS bullet, @join(@sorted_pairs(@collect_pairs(CAST(line_no AS INT), CASE WHEN bullets = 1 THEN trim(regexp_extract(line, '^\s*[-*]\s+(.+)$', 1)) ELSE trim(line) END)), '|') AS text FROM named WHERE sec > 0 AND b > 0 AND (bullets = 1 OR @matches(line, '^\s+\S')) GROUP BY file, v, sec, version, day, heading, b""",
    "address_choice": """WITH once AS (SELECT *, row_number() OVER (PARTITION BY place_id, url ORDER BY pos) AS again FROM address_page), first AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY CASE WHEN confidence >= 0.55e0 THEN 0 ELSE 1 END, pos) AS rn FROM once WHERE again = 1)
  SELECT place_id, CASE WHEN confidence >= 0.55e0 THEN url END AS url, CASE WHEN confidence >= 0.55e0 THEN 'found' WHEN confidence IS NULL THEN 'failed' ELSE 'low confidence' END AS outcome FROM first WHERE rn = 1""",
    "address_totals": """SELECT outcome, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(CAST(sum(tokens_in) AS DOUBLE) / 1e6 + CAST(sum(tokens_out) AS DOUBLE) * 5e0 / 1e6, 6) AS dollars
  FROM (SELECT CASE WHEN confidence >= 0.55e0 THEN 'found' WHEN confidence IS NULL THEN 'failed' ELSE 'low confidence' END AS outcome, tokens_in, tokens_out FROM address_page) GROUP BY outcome""",
}
