"""Columns that turn dirty names, URLs and profile references into keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts, tracking parameters and stop tokens of the key rules.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_src"]
CASELESS_HOSTS = ["x.com", "twitter.com", "github.com", "linkedin.com", "medium.com"]
SOURCES = [("arxiv.org", "arxiv"), ("github.com", "github"), ("producthunt.com", "producthunt"), ("news.ycombinator.com", "hn"), ("linkedin.com", "linkedin"), ("crunchbase.com", "crunchbase"), ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("devpost.com", "devpost"), ("mlh.io", "mlh")]
RELIABILITY = {"arxiv": 0.9, "github": 0.85, "crunchbase": 0.85, "accelerator": 0.8, "devpost": 0.7, "mlh": 0.7, "producthunt": 0.7, "news": 0.6, "personal_site": 0.6, "linkedin": 0.55, "youtube": 0.5, "hn": 0.5, "post": 0.5, "web": 0.4}
HONORIFICS = "prof professor dr phd md dphil herr frau mr mrs ms mx dipl ing msc bsc".split()
ORGANISATION_TOKENS = (
    "hackathon hack hacks makeathon hackfest datathon jam expo summit conference congress meetup festival challenge bootcamp accelerator incubator demoday cohort edition university universitaet "
    "universitat institute institut college gmbh ug ltd llc inc corp ventures capital partners foundation association society consortium committee"
).split()
LEGAL_FORMS = "gmbh ug ag kg ohg mbh eg ltd limited llc lp llp plc inc incorporated corp corporation co company bv nv sa sas sarl srl spa oyj oy ab as aps pte pty kk kft sro doo zoo".split()
FILLERS = "the of at de der des und and".split()
# "customer-storiesdashboard" is the list's own entry: two words run together there, kept as they are for equal results
GITHUB_RESERVED = (
    "about apps collections codespaces contact customer-storiesdashboard enterprise events explore features issues join login logout marketplace new notifications orgs organizations pricing pulls "
    "readme security settings sponsors stars topics trending signup site security-advisories"
).split()
TWITTER_RESERVED = "about account compose explore hashtag home i intent jobs login logout messages notifications privacy search settings share signup status tos welcome who_to_follow".split()
LINKEDIN_ARTIFACTS = "posts feed pulse company school groups jobs".split()
DEBRIS = ["http", "https", "www", "en"]
STRONG_KINDS = ("github", "linkedin", "twitter", "orcid")
_ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def fold(text: Column) -> Column:
    """Lower case without accents: Latin letters that decompose lose their marks, ß becomes ss, combining marks go."""
    lower = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ß", "ss")
    return F.regexp_replace(F.translate(lower, _ACCENTED, _PLAIN), r"\p{M}", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def comparison_text(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def _without_honorifics(words: Column) -> Column:
    titles = F.array(*map(F.lit, HONORIFICS))
    # the first place that holds no title; all words from there on
    first = F.array_position(F.transform(words, lambda w: F.array_contains(titles, w)), False)
    return F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(words, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(words), F.lit(1))))


def person_name(name: Column) -> Column:
    """Folded tokens of a person's name without leading titles."""
    return F.array_join(_without_honorifics(tokens(name)), " ")


def compact_name(name: Column) -> Column:
    """First and last token of a person's name: middle names do not tell people apart."""
    words = F.split(person_name(name), " ")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.element_at(words, 1), F.element_at(words, -1))).otherwise(F.element_at(words, 1))


def is_person(name: Column) -> Column:
    """Whether a name could be a human being's: no digits, separators or organisation words, and two tokens or more."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    words = _without_honorifics(tokens(raw))
    return (raw != "") & (F.lower(raw) != "none") & ~raw.rlike(r"(?U)\d") & ~raw.rlike(r"[&|/@!]") & raw.rlike(r"(?U)\s") & (F.size(words) >= 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, ORGANISATION_TOKENS)))


def split_name(full: Column) -> tuple[Column, Column]:
    words = F.filter(F.split(F.coalesce(full, F.lit("")), r"\s+"), lambda w: w != "")
    two = F.size(words) >= 2
    return F.when(two, F.element_at(words, 1)), F.when(two, F.element_at(words, -1))


def company_key(name: Column) -> Column:
    """Name tokens without legal forms; a name of legal forms only keeps them; null for none."""
    words = tokens(name)
    kept = F.filter(words, lambda w: ~w.isin(LEGAL_FORMS))
    return F.when(F.size(words) == 0, None).otherwise(F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), " "))


def domain_key(website: Column) -> Column:
    raw = F.trim(F.coalesce(website, F.lit("")))
    host = F.regexp_extract(F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw)), r"^[^:/?#]*://([^/?#]*)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.+$", ""), F.lit(""))


def institution_key(name: Column) -> Column:
    words = F.filter(tokens(F.regexp_replace(F.coalesce(name, F.lit("")), r"[(\[][^)\]]*[)\]]", " ")), lambda w: ~w.isin(FILLERS))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def city_key(name: Column) -> Column:
    """Folded words of a place's name with single spaces; null for none."""
    return F.nullif(F.trim(F.regexp_replace(fold(name), r"[^a-z0-9]+", " ")), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One key for all spellings of a page: https, no www, no fragment, no tracking, sorted parameters; hosts with caseless
    paths in lower case; the renderings of one paper under its abstract page. Empty and null stay as they are."""
    raw = F.trim(url)
    part = lambda g: F.regexp_extract(raw, r"^(?:([^:/?#]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", g)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    trimmed = F.regexp_replace(part(3), r"/+$", "")
    path = F.when(trimmed == "", "/").otherwise(trimmed)
    path = F.when(host.isin(CASELESS_HOSTS), F.lower(path)).otherwise(path)
    paper_host = F.when(host == "ar5iv.labs.arxiv.org", "arxiv.org").otherwise(host)
    paper = F.regexp_extract(path, r"(?i)^/(?:abs|pdf|html)/(\d{4}\.\d{4,5})(?:v\d+)?/?$", 1)
    path = F.when((paper_host == "arxiv.org") & (paper != ""), F.concat(F.lit("/abs/"), paper)).otherwise(path)
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda kv: (kv != "") & ~F.element_at(F.split(kv, "="), 1).isin(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.isNull() | (url == ""), url).otherwise(F.concat(F.lit("https://"), paper_host, path, query))


def content_hash(title: Column, summary: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))), r"(?U)\s+", " "))
    return F.when(words != "", F.sha2(words, 256))


def source_of(url: Column) -> Column:
    low, out = F.lower(F.coalesce(url, F.lit(""))), None
    for needle, name in SOURCES:
        out = F.when(low.contains(needle), name) if out is None else out.when(low.contains(needle), name)
    return out.otherwise("web")


def website(raw: Column) -> Column:
    """A site's URL with one scheme, without www, trailing slash and trk* parameters, the others sorted."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    part = lambda g: F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?", g)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(part(3), "&"), lambda kv: kv.rlike("^[^=]+=.+") & ~kv.startswith("trk")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.lit("https://"), host, F.regexp_replace(part(2), "/+$", ""), query))


def artifact_url(raw: Column) -> Column:
    """As `website`, with the path in lower case."""
    site = website(raw)
    at = F.instr(site, "?")
    path = F.when(at > 0, F.substring(site, F.lit(1), at - 1)).otherwise(site)
    return F.concat(F.lower(path), F.when(at > 0, F.substring(site, at, F.length(site))).otherwise(""))


def orcid_valid(digits: Column) -> Column:
    """The check character of sixteen ORCID digits (ISO 7064, mod 11-2)."""
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0), lambda a, d: F.pmod((a + F.coalesce(d.try_cast("int"), F.lit(0))) * 2, F.lit(11)))
    check = F.pmod(12 - total, F.lit(11))
    return digits.rlike(r"^\d{15}[\dXx]$") & (F.upper(F.substring(digits, 16, 1)) == F.when(check == 10, "X").otherwise(check.cast("string")))


# The hosts of profile sites, and below the shapes of handles on them.
_HOSTS = {"github": r"(^|\.)github\.com$", "twitter": r"(^|\.)(twitter|x)\.com$", "linkedin": r"(^|\.)linkedin\.com$|^linkedin\.", }


def parse_identity(kind: Column, raw: Column) -> Column:
    """STRUCT<value, artifact_url, rejected> of a profile reference: its canonical token, or the page it is evidence of, or
    why it is neither."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    result = lambda value=None, artifact=None, rejected=None: F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast("string").alias(n) for x, n in ((value, "value"), (artifact, "artifact_url"), (rejected, "rejected"))))
    full = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)", 1)), r"^www\.", ""), ":.*$", "")

    def segments(is_url: Column) -> Column:
        path = F.when(is_url, F.regexp_extract(full, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_replace(text, "^@+", ""))
        return F.filter(F.split(path, "/"), lambda s: s != "")

    def handled(name: str, known: str, decide) -> Column:
        is_url = text.contains("://") | F.lower(text).rlike(known)
        parts = segments(is_url)
        return F.when(is_url & ~host.rlike(_HOSTS[name]), result(rejected="wrong_host")).when(F.size(parts) == 0, result(rejected="malformed")).otherwise(decide(parts))

    def github(parts: Column) -> Column:
        login = F.element_at(parts, 1)
        return F.when(F.lower(login).isin(GITHUB_RESERVED + DEBRIS), result(rejected="reserved")).when(~login.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$"), result(rejected="malformed")).otherwise(result(value=F.lower(login)))

    def twitter(parts: Column) -> Column:
        name = F.element_at(parts, 1)
        return (
            F.when((F.size(parts) >= 2) & (F.lower(F.try_element_at(parts, F.lit(2))) == "status"), result(artifact=artifact_url(text)))
            .when(F.lower(name).isin(TWITTER_RESERVED + DEBRIS), result(rejected="reserved"))
            .when(~name.rlike(r"^[A-Za-z0-9_]{1,15}$"), result(rejected="malformed"))
            .otherwise(result(value=F.lower(name)))
        )

    def linkedin(parts: Column) -> Column:
        head = F.lower(F.element_at(parts, 1))
        profile = head.isin("in", "pub")
        slug = F.when(profile, F.try_element_at(parts, F.lit(2))).otherwise(F.element_at(parts, 1))
        slug = F.coalesce(F.try_url_decode(F.regexp_replace(slug, r"\+", "%2B")), slug)
        return F.when(head.isin(LINKEDIN_ARTIFACTS), result(artifact=artifact_url(text))).when(slug.isNull() | ~slug.rlike(r"(?U)^[\w\-%.]{3,100}$"), result(rejected="malformed")).otherwise(result(value=F.lower(slug)))

    found = F.regexp_extract(text, r"(\d{4}-?\d{4}-?\d{4}-?\d{3}[\dXx])", 1)
    digits = F.upper(F.regexp_replace(found, "-", ""))
    orcid = (
        F.when(found == "", result(rejected="malformed"))
        .when(~orcid_valid(digits), result(rejected="checksum"))
        .when(~digits.rlike("^0000000[1-9]"), result(rejected="not_assigned"))
        .otherwise(result(value=F.regexp_replace(digits, r"(.{4})(.{4})(.{4})(.{4})", "$1-$2-$3-$4")))
    )
    site = website(text)
    return (
        F.when(text == "", result(rejected="empty"))
        .when(kind == "github", handled("github", r"github\.com", github))
        .when(kind == "twitter", handled("twitter", r"twitter\.com|x\.com", twitter))
        .when(kind == "linkedin", handled("linkedin", r"linkedin\.", linkedin))
        .when(kind == "orcid", orcid)
        .when(kind == "website", F.when(site.isNotNull(), result(value=site)).otherwise(result(rejected="malformed")))
    )


def profile_url(kind: Column, value: Column) -> Column:
    prefix = F.when(kind == "github", "https://github.com/").when(kind == "twitter", "https://x.com/").when(kind == "linkedin", "https://www.linkedin.com/in/").when(kind == "orcid", "https://orcid.org/").when(kind == "website", "")
    return F.when(value != "", F.concat(prefix, value))


def _common_by_rows(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, from its table one row at a time: an array that each letter of `a`
    maps to the next."""
    letters = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.transform(letters, lambda c: F.lit(0))

    def next_row(row: Column, x: Column) -> Column:
        pairs = F.zip_with(letters, row, lambda c, above: F.struct(c.alias("c"), above.alias("above")))
        state = F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("diagonal"), F.array().cast("array<int>").alias("row")),
            lambda s, p: F.struct(
                p["above"].alias("diagonal"),
                F.concat(s["row"], F.array(F.when(p["c"] == x, s["diagonal"] + 1).otherwise(F.greatest(p["above"], F.coalesce(F.try_element_at(s["row"], F.lit(-1)), F.lit(0)))))).alias("row"),
            ),
        )
        return state["row"]

    table = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), start, next_row)
    return F.coalesce(F.try_element_at(table, F.lit(-1)), F.lit(0))


def _common_by_bits(a: Column, b: Column) -> Column:
    """The same for a `b` of up to 62 letters: its letters are the bits of a number, and each letter of `a` changes all of
    them in one addition."""
    letters = F.filter(F.split(b, ""), lambda c: c != "")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    every = bit(F.size(letters)) - 1

    def places(x: Column) -> Column:
        return F.aggregate(F.transform(letters, lambda c, i: F.when(c == x, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))

    def step(state: Column, m: Column) -> Column:
        met = state.bitwiseAND(m)
        return (state + met).bitwiseOR(state - met).bitwiseAND(every)

    masks = F.transform(F.filter(F.split(a, ""), lambda c: c != ""), places)
    return F.size(letters) - F.bit_count(F.aggregate(masks, every, step))


def name_ratio(a: Column, b: Column) -> Column:
    """Normalised insert-delete similarity of two names, 0 to 100: twice the longest common subsequence over both lengths."""
    total = F.length(a) + F.length(b)
    common = F.when(F.length(b) <= 62, _common_by_bits(a, b)).otherwise(_common_by_rows(a, b))
    return F.when(total == 0, 100.0).otherwise(200.0 * common / total)
