"""Rules that read one event at a time: press titles, filings, documents of regulators, cases, awards.

Each is a plain function DataFrame -> DataFrame for df.transform, known to RULES by name with its version and source
ids. Rows come out with RULE columns: those of a candidate, the name to be resolved (`name_hint`) and, beside the
pieces of evidence, where each stands (`locators`). Null and blank titles, names and dates give no candidate or ''.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from .classify import CANDIDATE, OFFICER_ITEM
from .terms import named_terms

RULE = [*CANDIDATE, "name_hint", "locators", "tier"]

# Verbs and titles of appointments.
APPOINTING = ["appoints", "names", "hires", "taps", "promotes", "elevates", "welcomes"]
SECURITY_TITLE = r"\bCISO\b|(?i:\bchief information security officer\b)|(?i:\bchief security officer\b)"
OFFICER_TITLE = r"\bCIO\b|(?i:\bchief information officer\b)|\bCTO\b|(?i:\bchief technology officer\b)"
SECURITY_CONTEXT = r"(?i)chief security officer|information security|cyber\s?security"
# Verbs by which a company speaks of its own incident, and what makes it one of security.
VICTIM_VERBS = [
    "confirms", "discloses", "announces", "reports", "notifies", "investigating", "investigates", "experienced", "experiences",
    "detected", "detects", "suffered", "suffers", "identified", "identifies", r"responds\s+to", r"provides\s+(?:an\s+)?update\s+on",
    r"issues\s+(?:a\s+)?statement\s+(?:on|regarding)", r"statement\s+(?:on|regarding)", r"updates?\s+on",
]
CYBER_PHRASES = [
    "cybersecurity incident", "cyber security incident", "cyber incident", "cyberattack", "cyber attack", "cyber-attack", "data breach",
    "data security incident", "data-security incident", "security breach", "network breach", "security incident", "ransomware",
    "unauthorized access", "malware attack", "information security incident", "data theft",
]
# Further verbs that the security press uses, and marks of an attacker's claim.
PRESS_VERBS = [
    *(v for v in VICTIM_VERBS if not v.startswith(("statement", "updates"))), "confirmed", "disclosed", "announced", "reported", "notified",
    r"responding\s+to", r"hit\s+by", r"struck\s+by", r"impacted\s+by", r"affected\s+by", r"targeted\s+by",
]
CLAIM = (
    r"(?i)claims?\s+to\s+have\s+(?:breached|hacked|stolen|attacked|hit)|claims?\s+(?:responsibility|the\s+breach)|(?:data\s+)?leak\s+site|"
    r"(?:up\s+for|put\s+up\s+for|offered\s+for|listed\s+for)\s+sale|data\s+for\s+sale|extortion\s+(?:attempt|demand|scheme)?|"
    r"ransomware\s+gang\s+claims|allegedly\s+(?:breached|hacked|stole)"
)
CLAIM_SOURCES = ["bleepingcomputer"]
CORROBORATED, UNCONFIRMED = "corroborated", "unconfirmed_early_warning"
# Agencies, terms and confidences of the rule on regulators' documents.
ENERGY_AGENCY, TRANSPORT_AGENCY = "federal-energy-regulatory-commission", "transportation-security-administration"
RULEMAKING = ["Rule", "Proposed Rule"]
SECURITY_TERMS = ["security directive", "pipeline security", "rail security", "surface transportation security", "cybersecurity requirements"]
ENFORCING = r"(?i)\b(?:enforcement|civil penalt(?:y|ies)|penalt(?:y|ies)|violations?|settlements?)\b"
RELIABILITY = r"(?i:critical infrastructure protection|reliability standard)|\bCIP\b"
COMPLIANCE = r"(?i)must comply|required to comply|compliance (?:date|deadline|obligations?)"
NOTICE_HEADLINE = "FERC enforcement notice: CIP/reliability enforcement action affecting registered entities"
DECREE_NOTE = "Judicial civil (JDC) case category: referred to DOJ and filed in federal court, the mechanism by which an EPA environmental enforcement settlement becomes a consent decree."
AWARDING = ["department of energy", "department of homeland security"]
AWARDING_PART = "cybersecurity and infrastructure security agency"
# Case types with their confidence.
CASE_TYPES = {"Corrective Action Order": 0.85, "Notice of Probable Violation": 0.8, "Warning Letter": 0.7}
CASE_SUBSECTORS = ["midstream", "lng"]
CASE_DETAILS = {"violation_category": "Violation category", "cited_regulations": "Cited regulations"}
# How severe each case type is.
SEVERITIES = {
    "Corrective Action Order": "Corrective Action Order (CAO): PHMSA's most severe pre-hearing enforcement mechanism, ordering immediate corrective measures to address a pipeline integrity threat.",
    "Notice of Probable Violation": "Notice of Probable Violation (NOPV): a formal PHMSA finding of a probable regulatory violation, which may lead to a civil penalty or compliance order.",
    "Warning Letter": "Warning Letter: PHMSA's least severe enforcement notice, documenting a violation without a proposed civil penalty.",
}
# Words of a deal, and words of market talk that rule a title out.
DEAL = r"(?iU)\b(?:mergers?|merged|merges|merging|acquisitions?|acquires?|acquired|acquiring|divestitures?|divests?|divesting|takeovers?|to\s+buy|combines\s+with)\b"
MARKET_TALK = r"(?iU)\b(?:stocks?|shares?|price\s+targets?|dividends?|watchlist|bullish|bearish|earnings|buy\s+and\s+hold|hand\s+over\s+fist|underperforming|rallied)\b"

DOCUMENT = (
    "title string, abstract string, type string, publication_date string, effective_on string, comments_close_on string, "
    "agencies array<string>, docket_ids array<string>, cfr_references array<string>"
)


def blank(value: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.trim(F.coalesce(value, F.lit("")))


def filled(value: Column) -> Column:
    """The text itself, null if it is blank."""
    return F.when(blank(value) != "", value)


def _piece(text: Column, locator: str) -> Column:
    return F.struct(text.alias("text"), F.lit(locator).alias("locator"))


def _cited(*pieces: Column) -> Column:
    """An array of the pieces that have a text."""
    return F.filter(F.array(*pieces), lambda e: e["text"].isNotNull())


def _card(trigger: str, headline: Column, confidence, cited: Column, scope="account", hint: Column | None = None, entity: Column | None = None, order: int = 0, tier: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(trigger).alias("trigger_id"), as_column(scope).alias("scope"), (none if entity is None else entity).alias("entity_id"), headline.alias("headline"),
        F.transform(cited, lambda e: e["text"]).alias("evidence"), as_column(confidence).cast("double").alias("confidence"), F.lit(order).alias("order"),
        (none if hint is None else hint).alias("name_hint"), F.transform(cited, lambda e: e["locator"]).alias("locators"), (none if tier is None else tier).alias("tier"),
    )


def _emitted(rows: DataFrame, *cards: Column) -> DataFrame:
    """A row for each card that isn't null."""
    out = rows.withColumn("_c", F.explode(F.array_compact(F.array(*cards))))
    return out.select("raw_event_id", "event_date", "_c.*").select(RULE)


def _grammar(title: Column, verbs: list[str]) -> tuple[Column, Column]:
    """What stands before and after the first of the verbs, '' where there is none or the subject isn't 2 to 80 characters long."""
    pattern = rf"(?is)^(.{{2,80}}?)\s+(?:{'|'.join(verbs)})\b(.*)$"
    return F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2)


def officer_title(role: Column, context: Column) -> Column:
    """struct(term, confidence) of the first telling title; a bare CSO counts only where the context is of security."""
    first = lambda pattern: filled(F.regexp_extract(role, pattern, 0))
    cso = F.when(context.rlike(SECURITY_CONTEXT), first(r"\bCSO\b"))
    security = F.coalesce(*(first(p) for p in SECURITY_TITLE.split("|")), cso)
    other = F.coalesce(*(first(p) for p in OFFICER_TITLE.split("|")))
    term = F.coalesce(security, other)
    return F.when(term.isNotNull(), F.struct(term.alias("term"), F.when(security.isNotNull(), 0.9).otherwise(0.75).alias("confidence")))


def appointments(press: DataFrame, window: int = 600) -> DataFrame:
    """Press titles (title, description) in which a company gets an officer of security or technology.

    Of the description the first `window` characters count, as context of a bare CSO only.
    """
    rows = press.withColumns({"_t": t.plain_text(F.coalesce("title", F.lit(""))), "_d": F.substring(t.plain_text(F.coalesce("description", F.lit(""))), 1, window)})
    company, rest = _grammar(F.col("_t"), APPOINTING)
    joins = r"(?is)\bjoins\s+(.{2,80}?)\s+as\b(.*)$"
    region = F.when(rest.rlike(r"(?i)\bas\b"), F.regexp_extract(rest, r"(?is)^.*?\bas\b(.*)$", 1)).otherwise(rest)
    rows = rows.withColumns({"_who": F.when(company != "", company).otherwise(F.regexp_extract("_t", joins, 1)), "_role": F.when(company != "", region).otherwise(F.regexp_extract("_t", joins, 2))})
    rows = rows.withColumns({"_who": t.plausible_company(F.col("_who")), "_hit": officer_title(F.col("_role"), F.concat_ws(" ", "_t", "_d"))})
    leaned = (F.col("_hit.term") == "CSO") & ~F.col("_t").rlike(SECURITY_CONTEXT) & (F.col("_d") != "")
    cited = _cited(_piece(F.col("_t"), "title"), _piece(F.when(leaned, F.substring("_d", 1, 300)), "description"))
    rows = rows.where((F.col("_who") != "") & F.col("_hit").isNotNull())
    return _emitted(rows, _card("leadership_change", F.col("_t"), F.col("_hit.confidence"), cited, hint=F.col("_who")))


def officer_filings(filings: DataFrame) -> DataFrame:
    """Filings with the officer item whose document names (doc_description, primary_document) hold a telling title."""
    names = ["doc_description", "primary_document"]
    whole = F.concat_ws(" ", *(F.coalesce(n, F.lit("")) for n in names))
    rows = filings.where(F.col("form").isin("8-K", "8-K/A") & F.array_contains("items", OFFICER_ITEM) & (blank(F.col("entity_id").cast("string")) != ""))
    rows = rows.withColumns({"_w": whole, "_hit": officer_title(whole, whole)}).where("_hit is not null")
    cited = _cited(*(_piece(F.when(officer_title(F.coalesce(n, F.lit("")), F.col("_w")).isNotNull(), F.col(n)), n) for n in names))
    rows = rows.withColumn("_e", cited).where(F.size("_e") > 0)
    headline = F.concat(F.lit("8-K Item 5.02 leadership change ("), F.col("_hit.term"), F.lit(")"))
    return _emitted(rows, _card("leadership_change", headline, F.col("_hit.confidence"), F.col("_e"), entity=F.col("entity_id").cast("string")))


def company_statements(press: DataFrame) -> DataFrame:
    """Press titles in which a company speaks of a security incident of its own."""
    rows = press.withColumn("_t", t.plain_text(F.coalesce("title", F.lit(""))))
    company, rest = _grammar(F.col("_t"), VICTIM_VERBS)
    rows = rows.where(rest.rlike(f"(?i){'|'.join(CYBER_PHRASES)}")).withColumn("_who", t.plausible_company(company)).where("_who <> ''")
    return _emitted(rows, _card("own_incident", F.col("_t"), 0.85, _cited(_piece(F.col("_t"), "title")), hint=F.col("_who"), tier=F.lit("confirmed")))


def one_each(resolutions: DataFrame) -> DataFrame:
    """One resolution per event, with its confidence as _sure: of several a match, then the surest, then the smallest entity."""
    row = F.struct("status", "entity_id", F.col("confidence").alias("_sure"))
    order = F.struct(F.col("status") != "matched", -F.coalesce("confidence", F.lit(0.0)), F.col("status"), F.col("entity_id"))
    return resolutions.groupBy("raw_event_id").agg(F.min_by(row, order).alias("_r")).select("raw_event_id", "_r.*")


def leak_listings(listings: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Victim listings (crew, victim, industry) by how the victim's name was resolved (raw_event_id, status, entity_id, confidence).

    A match gives the account's own card; no match a peer's if the industry tag is the watchlist's; what needs review gives none.
    """
    rows = listings.withColumn("victim", blank(F.col("victim"))).where("victim <> ''").join(one_each(resolutions), "raw_event_id")
    rows = rows.withColumns({"event_date": F.substring(F.coalesce("event_date", F.lit("")), 1, 10), "crew": blank(F.col("crew"))})
    site = F.when(F.col("crew") != "", F.concat(F.lit("the "), "crew", F.lit(" ransomware leak site"))).otherwise("a ransomware leak site")
    seen = F.when(F.col("event_date") != "", F.concat(F.lit(", discovered "), "event_date")).otherwise("")
    listed = F.concat(F.lit('ransomware.live lists "'), "victim", F.lit('" '))
    own = F.concat(listed, F.lit("as a victim on "), site, seen, F.lit("."))
    peer = F.concat(listed, F.lit("on a ransomware leak site"), seen, F.lit(". Unverified: no company, regulator, or SEC confirmation."))
    tier = F.lit(UNCONFIRMED)
    return _emitted(
        rows,
        F.when(F.col("status") == "matched", _card("own_incident", F.concat(F.lit("Listed on "), site, F.lit(" - unverified early warning")), F.least(F.lit(0.5), "_sure"), _cited(_piece(own, "victim")), entity=F.col("entity_id").cast("string"), tier=tier)),
        F.when((F.col("status") == "none") & t.is_peer_industry(F.col("industry")), _card("peer_incident", F.concat(F.lit("Sector peer "), "victim", F.lit(" listed on a ransomware leak site - unverified early warning")), 0.45, _cited(_piece(peer, "victim")), "sector", order=1, tier=tier)),
    )


def press_disclosures(press: DataFrame) -> DataFrame:
    """Security press titles with `name`: the company that discloses an incident; '' if its name is garbled, null where none does."""
    rows = press.withColumn("title", t.plain_text(F.coalesce("title", F.lit(""))))
    company, rest = _grammar(F.col("title"), PRESS_VERBS)
    return rows.withColumn("name", F.when(rest.rlike(f"(?i){'|'.join(CYBER_PHRASES)}"), t.plausible_company(company)))


def press_incidents(disclosures: DataFrame, resolutions: DataFrame, tier: str = CORROBORATED) -> DataFrame:
    """`press_disclosures` (with `source`) by how their names were resolved; some sources' claims without a company give an unnamed peer.

    A name without a resolution, like one that needs review, gives no card.
    """
    found = one_each(resolutions)
    rows = disclosures.where("title <> ''").join(found, "raw_event_id", "left").withColumn("event_date", F.substring(F.coalesce("event_date", F.lit("")), 1, 10))
    named, title = F.coalesce(F.col("name"), F.lit("")) != "", F.col("title")
    said = F.concat(F.lit("Security-press reporting indicates "), "name", F.lit(" disclosed a cybersecurity incident. Industry match is unverified."))
    claim = F.lit("Security-press reporting references an unverified attacker or leak-site breach claim against an organization.")
    return _emitted(
        rows,
        F.when(named & (F.col("status") == "matched"), _card("own_incident", title, F.least(F.lit(0.7), "_sure"), _cited(_piece(title, "title")), entity=F.col("entity_id").cast("string"), tier=F.lit(tier))),
        F.when(named & (F.col("status") == "none"), _card("peer_incident", F.concat(F.lit("Possible sector peer: "), "name", F.lit(" disclosed a cybersecurity incident - security-press reported")), 0.6, _cited(_piece(said, "source")), "sector", order=1, tier=F.lit(tier))),
        F.when(F.col("name").isNull() & F.col("source").isin(CLAIM_SOURCES) & title.rlike(CLAIM), _card("peer_incident", F.lit("Possible sector peer named in an unverified breach claim - early warning"), 0.45, _cited(_piece(claim, "source")), "sector", order=2, tier=F.lit(UNCONFIRMED))),
    )


def regulatory_documents(documents: DataFrame) -> DataFrame:
    """Documents of two regulators (JSON `payload`): security directives, revisions of standards, enforcement notices.

    Each needs a clock: a date in effect, one for comments, or words on compliance. Up to four cards come from one document.
    """
    d = documents.withColumn("p", F.from_json("payload", DOCUMENT))
    rows = d.select("raw_event_id", F.coalesce(filled(F.col("p.publication_date")), "event_date", F.lit("")).alias("event_date"), "p.*")
    rows = rows.withColumns({"title": blank(F.col("title")), "abstract": F.coalesce("abstract", F.lit("")), "kind": F.coalesce("type", F.lit(""))})
    rows = rows.withColumns({"_e": F.nullif("effective_on", F.lit("")), "_c": F.nullif("comments_close_on", F.lit("")), "_all": F.concat_ws(" ", "title", "abstract")})
    rows = rows.where((F.col("title") != "") & (F.col("_e").isNotNull() | F.col("_c").isNotNull() | F.col("abstract").rlike(COMPLIANCE)))
    whole, title, kind = F.col("_all"), F.col("title"), F.col("kind")
    # Each entry by itself: one that isn't an object has no slug, and the others count.
    of = lambda slug: F.coalesce(F.exists("agencies", lambda a: F.coalesce(F.get_json_object(a, "$.slug") == slug, F.lit(False))), F.lit(False))
    scope = F.when(F.col("_e").isNotNull(), "sector").otherwise("regulatory_calendar")

    def cited(pattern: str) -> Column:
        found = F.transform(t.sentences_with(F.col("abstract"), pattern), lambda s: _piece(s, "abstract"))
        clocks = _cited(_piece(F.concat(F.lit("Effective on "), "_e"), "effective_on"), _piece(F.concat(F.lit("Comments close on "), "_c"), "comments_close_on"))
        return F.concat(F.array(_piece(title, "title")), found, clocks)

    terms = f"(?i){'|'.join(SECURITY_TERMS)}"
    from_docket = F.exists("docket_ids", lambda x: F.upper(F.trim(x)).rlike("^R[MD]"))
    from_code = F.exists("cfr_references", lambda c: F.coalesce((F.get_json_object(c, "$.title") == "18") & (F.get_json_object(c, "$.part") == "40"), F.lit(False)))
    context = whole.rlike(r"(?i:critical infrastructure protection)|\bCIP-\d{3}\b") | F.coalesce(from_docket, F.lit(False)) | F.coalesce(from_code, F.lit(False))
    # What makes a directive one for pipelines.
    directive = of(TRANSPORT_AGENCY) & kind.isin(RULEMAKING) & whole.rlike(terms) & whole.rlike("(?i)pipeline|lng|liquefied natural gas")
    revision = of(ENERGY_AGENCY) & kind.isin(RULEMAKING) & whole.rlike("(?i)reliability standard") & context
    notice = of(ENERGY_AGENCY) & (kind == "Notice") & whole.rlike(ENFORCING) & whole.rlike(RELIABILITY)
    name = t.named_company(title)
    return _emitted(
        rows,
        F.when(directive, _card("tsa_security_directive", t.headline(F.lit("TSA"), kind, title), 0.8, cited(terms), scope)),
        F.when(revision, _card("nerc_cip_revision", t.headline(F.lit("FERC"), kind, title), 0.8, cited(RELIABILITY), scope, order=1)),
        F.when(notice, _card("nerc_enforcement", F.lit(NOTICE_HEADLINE), 0.8, cited(ENFORCING), "sector", order=2)),
        F.when(notice & name.isNotNull(), _card("nerc_enforcement", F.concat(F.lit("FERC enforcement action names "), name), 0.75, cited(ENFORCING), hint=name, order=3)),
    )


def settled_decrees(cases: DataFrame) -> DataFrame:
    """Settled judicial civil cases (JSON `payload`) by the defendant's clean name."""
    fields = "CaseNumber string, CaseName string, CaseCategoryCode string, CivilCriminalIndicator string, SettlementDate string, PrimaryLaw string, EnfOutcome string"
    rows = cases.select("raw_event_id", F.coalesce("event_date", F.lit("")).alias("event_date"), F.from_json("payload", fields).alias("p")).select("raw_event_id", "event_date", "p.*")
    rows = rows.where((F.col("CaseCategoryCode") == "JDC") & (F.col("CivilCriminalIndicator") == "CI") & (blank(F.col("SettlementDate")) != ""))
    rows = rows.withColumn("_n", t.case_name(F.col("CaseName"))).where("_n <> ''")
    told = lambda words, c: F.concat(F.lit(words), F.nullif(c, F.lit("")))
    cited = _cited(
        _piece(F.concat(F.lit("Case "), F.coalesce("CaseNumber", F.lit("")), F.lit(": "), "CaseName"), "case_name"),
        _piece(told("Primary law: ", "PrimaryLaw"), "primary_law"),
        _piece(told("Settled ", "SettlementDate"), "settlement_date"),
        _piece(told("Enforcement outcome: ", "EnfOutcome"), "enf_outcome"),
        _piece(F.lit(DECREE_NOTE), "classifier_note"),
    )
    law = F.coalesce(F.nullif("PrimaryLaw", F.lit("")), F.lit("environmental"))
    headline = t.cut_to(F.concat(F.lit("EPA judicial civil enforcement settlement ("), law, F.lit("): "), "_n"), 140)
    return _emitted(rows, _card("audit_consent_decree", headline, 0.75, cited, hint=F.col("_n")))


def qualifying_awards(awards: DataFrame) -> DataFrame:
    """Awards (JSON `payload`) of two departments, or of an office named so in the awarding part."""
    names = {"Award ID": "id", "Recipient Name": "recipient", "Awarding Agency": "agency", "Awarding Sub Agency": "part", "Start Date": "start", "Description": "about"}
    rows = awards.select("raw_event_id", "event_date", *(F.get_json_object("payload", f"$['{n}']").alias(a) for n, a in names.items()))
    rows = rows.withColumns({c: blank(F.col(c)) for c in ("id", "recipient", "agency")})
    whose = F.lower("agency").isin(AWARDING) | F.lower(F.coalesce("part", F.lit(""))).contains(AWARDING_PART)
    rows = rows.where((F.col("id") != "") & (F.col("recipient") != "") & (F.col("agency") != "") & whose)
    rows = rows.withColumn("event_date", F.coalesce(F.nullif("event_date", F.lit("")), blank(F.col("start"))))
    part = F.coalesce(F.concat(F.lit(" ("), F.nullif("part", F.lit("")), F.lit(")")), F.lit(""))
    cited = _cited(
        _piece(F.concat(F.lit("Award "), "id", F.lit(": "), F.coalesce(F.nullif("about", F.lit("")), F.lit("(no description provided)"))), "description"),
        _piece(F.concat(F.lit("Awarding agency: "), "agency", part), "awarding_agency"),
        _piece(F.concat(F.lit("Award start date: "), F.nullif("start", F.lit(""))), "start_date"),
    )
    headline = t.cut_to(F.concat(F.lit("USAspending capital-project award ("), "agency", F.lit("): "), "recipient"), 140)
    return _emitted(rows, _card("capital_project", headline, 0.75, cited, hint=F.col("recipient")))


def pipeline_cases(cases: DataFrame, resolutions: DataFrame, tops: DataFrame, entities: DataFrame, severities: dict[str, str] | None = None) -> DataFrame:
    """Enforcement cases whose operator was matched to an entity whose uppermost account is of the trade.

    `cases` has raw_event_id, event_date, case_id, case_type, operator and opened; `resolutions` raw_event_id, status, entity_id
    and confidence; `tops` entity_id and top; `entities` entity_id and subsector. Where cases have violation_category and
    cited_regulations, these are cited too; `severities` (such as SEVERITIES) says what a type means.
    """
    trade = entities.where(F.col("subsector").isin(CASE_SUBSECTORS)).select(F.col("entity_id").alias("top"))
    inside = tops.join(trade, "top", "left_semi").select("entity_id")
    hits = one_each(resolutions).where("status = 'matched'").select("raw_event_id", "entity_id", "_sure").join(inside, "entity_id", "left_semi")
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in CASE_TYPES.items() for x in kv)), F.col("_type"))
    rows = cases.withColumns({"_type": blank(F.col("case_type")), "_op": blank(F.col("operator"))}).where(F.col("_type").isin(list(CASE_TYPES)) & (F.col("_op") != ""))
    rows = rows.join(hits, "raw_event_id").withColumn("event_date", F.coalesce("event_date", F.lit("")))
    cited = _cited(
        _piece(F.concat(F.lit("CPF "), F.coalesce(F.col("case_id").cast("string"), F.lit("")), F.lit(": "), "_type", F.lit(" against "), "operator"), "case"),
        *(_piece(F.concat(F.lit(f"{said}: "), filled(F.col(c))), c) for c, said in CASE_DETAILS.items() if c in cases.columns),
        _piece(F.concat(F.lit("Opened "), filled(F.col("opened"))), "opened_date"),
        _piece(F.element_at(F.create_map(*(F.lit(x) for kv in severities.items() for x in kv)), F.col("_type")) if severities else F.concat(F.lit("Severity: "), "_type"), "severity"),
    )
    headline = t.cut_to(F.concat(F.lit("PHMSA "), "_type", F.lit(": "), "_op"), 140)
    return _emitted(rows, _card("pipeline_enforcement_action", headline, F.least(sure, F.col("_sure")), cited, entity=F.col("entity_id").cast("string")))


def deals(articles: DataFrame, terms: list[str]) -> DataFrame:
    """Article titles on a deal, not on the market, with a card per watchlist term named: a trial that is reported, not stored.

    `terms` is a configured list, of any length; longer terms win over shorter ones at the same place.
    """
    rows = articles.withColumn("_t", t.squeezed(F.coalesce("title", F.lit("")))).where(F.col("_t").rlike(DEAL) & ~F.col("_t").rlike(MARKET_TALK))
    rows = rows.withColumn("_hits", named_terms(articles.sparkSession, F.col("_t"), terms))
    hits = F.col("_hits")
    first = F.filter(hits, lambda x, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))
    rows = rows.withColumn("_term", F.explode(first)).drop("_hits")
    headline = t.cut_to(F.concat("_term", F.lit(" in M&A coverage: "), "_t"), 140)
    return _emitted(rows, _card("ma_divestiture", headline, 0.6, _cited(_piece(F.col("_t"), "title")), hint=F.col("_term")))


class Rule(NamedTuple):
    version: str
    sources: list[str]
    apply: object


#: Rules by name.
RULES = {
    "appointments": Rule("1.0", ["presswire"], appointments),
    "officer_filings": Rule("1.0", ["filings"], officer_filings),
    "company_statements": Rule("1.0", ["presswire"], company_statements),
    "leak_listings": Rule("1.2", ["ransomware_live"], leak_listings),
    "press_incidents": Rule("1.2", ["the_record", "bleepingcomputer"], press_incidents),
    "regulatory_documents": Rule("1.1", ["federal_register"], regulatory_documents),
    "settled_decrees": Rule("1.0", ["epa_echo"], settled_decrees),
    "qualifying_awards": Rule("1.0", ["usaspending"], qualifying_awards),
    "deals": Rule("0.1", ["gdelt"], deals),
    "pipeline_cases": Rule("1.0", ["phmsa"], pipeline_cases),
}
