"""Rule tables and constants.

Two kinds of values live here:

* FIXED VALUES that must equal the reference application's behaviour (spellings,
  threshold, texts, formats). They are listed plainly, in the order the
  reference states them.
* Our own rule tables for the re-aimed news and scoring rules (event rules by words and their
  distances, tier rules). Words are runs of letters and digits of any script, in lower case.
"""

from __future__ import annotations

import datetime as _dt

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference)
# ---------------------------------------------------------------------------
# Flag threshold: a decision is a risk at level >= 3; levels run 0..5.
FLAG_THRESHOLD = 3
LEVEL_MIN = 0
LEVEL_MAX = 5
# Tri-state flag spellings, after trim + lower-case.
FLAG_NULL_SPELLINGS = ("", "none", "nan")
FLAG_TRUE_SPELLINGS = ("1", "1.0", "true", "y", "yes")
FLAG_FALSE_SPELLINGS = ("0", "0.0", "false", "n", "no")
# Default batch size of a monitor run.
DEFAULT_BATCH_SIZE = 100
# Recency window of the news search, in days.
RECENCY_DAYS = 90
# Cell text formats.
TIMESTAMP_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"
NOTE_NAME_PREFIX = "research_"
NOTE_NAME_STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"
NOTE_NAME_SUFFIX = ".md"
NOTE_DIR_DEFAULT = "unknown"
NOTE_MISSING_LABEL = "N/A"
NOTE_MISSING_TEXT = "No research file found."
# Notification texts.
STATUS_NEW = "NEW RISK"
STATUS_CLEARED = "CLEARED"
NO_CHANGES_MESSAGE = "No risk changes to notify."
ALERT_HEADER_FORMAT = "{new} new risks, {cleared} cleared"
ALERT_LINE_FORMAT = "{status} - {vendor}: Level {level}. {summary}"
MISSING_VALUE_TEXT = "null"
MISSING_LEVEL_TEXT = "unknown"
MISSING_REASON_TEXT = "No reason recorded."
SECTION_SEPARATOR = "\n\n---\n\n"
EMPTY_QUEUE_MESSAGE = "_No vendors in the book._"
QUEUE_PREVIEW_TITLE = "**Next {n} vendor(s) by oldest Last Checked Date:**"
RESULT_FLAGGED_LABEL = "⚠ flagged"
RESULT_CLEAR_LABEL = "clear"
NO_VENDORS_MESSAGE = "No vendors to process."
# Display columns of the vendor book view, in order (our snake-case names).
DISPLAY_COLUMNS = (
    "vendor", "category", "hq_country", "last_checked",
    "risk_level", "is_risk", "risk_reason", "last_risk_eval",
)
# Spreadsheet headers of the book and our names for them.
BOOK_HEADERS = {
    "Company / Brand": "vendor", "Category": "category", "HQ Country": "hq_country", "Last Checked Date": "last_checked",
    "Risk_level": "risk_level", "is_risk": "is_risk", "Risk_Reason": "risk_reason", "Last Risk Eval": "last_risk_eval",
}
# Search query forms per vendor: name, aliases, name + "announcement",
# name + "filing", name + the year of the given date.
QUERY_SUFFIX_ANNOUNCEMENT = "announcement"
QUERY_SUFFIX_FILING = "filing"
# Writing rules: banned characterisations, quote limit.
BANNED_TONE_WORDS = ("concern", "warning", "red flag", "threat", "disruption")
QUOTE_MAX_WORDS = 15
QUOTES_PER_SOURCE = 1
# Older matters: concluding verbs drop them, continuing phrases keep them.
CONCLUDING_WORDS = ("settled", "resolved", "closed")
CONTINUING_PHRASES = ("remains pending", "remains in effect", "continued")
# Corroboration: a single press source alleging level 4-5 caps at 3.
CAP_LEVEL = 3
CAP_FROM_LEVEL = 4
PRIMARY_TIER = 1
# Restrictions on new models only score 4, not 5.
NEW_MODELS_ONLY_CAP = 4

# ---------------------------------------------------------------------------
# Our rule tables (re-aimed English rules; not reference data)
# ---------------------------------------------------------------------------
# Default parameters of the test bindings.
AS_OF = _dt.date(2024, 1, 30)
RUN_START = _dt.datetime(2024, 1, 29, 12, 0, 0)
QUEUE_K = 25
ALERT_PAGE_BYTES = 1 << 18  # an alert page holds about so many bytes of text

# Event rules: (name, kind, level, anchor words, needs, blocks). Texts are read sentence by sentence, as
# lower-case words. A rule fires at an anchor word when each need ("frame: words") has one of its words in
# that frame around the anchor, and no block has. Frames in words from the anchor: FRAMES; "sentence" is
# the whole sentence. Kinds: "in", "out" and "transit" are scope categories (R4), "rubric" are conditions
# of a fixed level (R12), "mark" are carve-out markers (R15). A negated anchor fires no rubric rule.
FRAMES = {"near": (-8, 8), "close": (-4, 4), "next": (1, 1), "prev": (-1, -1)}
NEGATION_BEFORE = (-5, -1)  # a negator in this frame denies the anchor
NEGATION_AFTER = (1, 6)     # so does a lifting word in this one
NEGATORS = "no not never without denied denies deny denying unlikely neither nor none avoid avoids avoided avoiding averted averts"
LIFTERS = "lifted removed cleared dismissed averted avoided denied rescinded overturned reversed cancelled canceled"
_FILED = ("near:file files filed filing protection petition petitions bankruptcy court creditors enter enters entered under seek seeks sought "
          "reorganization proceeding proceedings")
_CARVE = "sentence:carve carveout exempt exempts exempted exemption exemptions"
_IMPORTS = "near:import imports importing export exports exporting"
EVENT_RULES = (
    # scope: in
    ("ownership_change", "in", 0, "acquired acquires acquisition merger merged takeover buyout", (), ()),
    ("ownership_change", "in", 0, "control ownership", ("close:change changes changed",), ()),
    ("insolvency_restructuring", "in", 0, "chapter", ("next:7 11", _FILED), ()),
    ("insolvency_restructuring", "in", 0, "insolvent insolvency insolvencies bankrupt bankruptcy bankruptcies restructuring receivership", (), ()),
    ("insolvency_restructuring", "in", 0, "concern", ("prev:going",), ()),
    ("facility", "in", 0, "plant plants facility facilities factory factories", (), ()),
    ("production_shipment", "in", 0, "production capacity shipment shipments shipping output", (), ()),
    ("sanctions_export", "in", 0, "list", ("prev:entity covered",), ()),
    ("sanctions_export", "in", 0, "sanction sanctions sanctioned sanctioning ofac bis uflpa", (), ()),
    ("sanctions_export", "in", 0, "control controls", ("prev:export",), ()),
    ("certification_regulatory", "in", 0, "recall recalls recalled recalling certification certifications regulator regulators regulatory enforcement", (), ()),
    ("litigation", "in", 0, "litigation lawsuit court sued settled settlement", (), ()),
    ("executive_change", "in", 0, "ceo cfo appointed resigned departure", (), ()),
    ("financial_results", "in", 0, "revenue losses results earnings profit", (), ()),
    ("product_lifecycle", "in", 0, "launched launches discontinued discontinues", (), ()),
    ("supply_agreement", "in", 0, "agreement agreements", ("prev:supply",), ()),
    ("supply_agreement", "in", 0, "contract contracts", (), ()),
    ("supply_agreement", "in", 0, "customer", ("next:win loss",), ()),
    # scope: out
    ("share_price", "out", 0, "price", ("prev:share stock",), ()),
    ("share_price", "out", 0, "shares", ("next:fell rose",), ()),
    ("analyst_rating", "out", 0, "analyst analysts", (), ()),
    ("analyst_rating", "out", 0, "price", ("next:target targets",), ()),
    ("market_commentary", "out", 0, "market", ("next:commentary outlook",), ()),
    ("product_review", "out", 0, "review reviews", ("prev:product",), ()),
    ("product_review", "out", 0, "hands", ("next:on",), ()),
    ("benchmark", "out", 0, "benchmark benchmarks", (), ()),
    ("award", "out", 0, "award awards awarded", (), ()),
    ("marketing", "out", 0, "marketing advertise advertised advertises advertiser advertisers advertising advertisement advertisements campaign campaigns", (), ()),
    ("opinion_speculation", "out", 0, "opinion opinions speculate speculates speculated speculating speculation speculations rumor rumors rumour rumours", (), ()),
    # goods in transit
    ("goods_in_transit", "transit", 0, "port", ("next:congestion strike strikes",), ()),
    ("goods_in_transit", "transit", 0, "carrier", ("next:delay delays",), ()),
    ("goods_in_transit", "transit", 0, "freight", ("next:rate rates",), ()),
    ("goods_in_transit", "transit", 0, "vessel vessels weather typhoon hurricane", (), ()),
    # level 5
    ("insolvency_proceeding", "rubric", 5, "chapter", ("next:7 11", _FILED), ()),
    ("insolvency_proceeding", "rubric", 5, "insolvency", ("near:proceeding proceedings file files filed filing declare declares declared open opens opened petition court",), ()),
    ("insolvency_proceeding", "rubric", 5, "insolvent bankrupt bankruptcy insolvenzverfahren redressement", (), ()),
    ("insolvency_proceeding", "rubric", 5, "liquidation", ("next:judiciaire",), ()),
    ("insolvency_proceeding", "rubric", 5, "rehabilitation", ("prev:civil",), ()),
    ("receivership", "rubric", 5, "receivership", (), ()),
    ("receivership", "rubric", 5, "receiver receivers", ("close:appoint appoints appointed named",), ()),
    ("administration", "rubric", 5, "administration", ("prev:enter enters entered entering into in",), ()),
    ("administration", "rubric", 5, "administration", ("next:was entered",), ()),
    ("administration", "rubric", 5, "administrator administrators", ("close:appoint appoints appointed called",), ()),
    ("administration", "rubric", 5, "cva", (), ()),
    ("administration", "rubric", 5, "arrangement", ("prev:voluntary",), ()),
    ("payment_default", "rubric", 5, "default defaults defaulted", ("near:payment payments interest principal bond bonds loan loans debt debts note notes",), ()),
    ("liquidation", "rubric", 5, "liquidation liquidated liquidating", (), ("next:judiciaire",)),
    ("liquidation", "rubric", 5, "wound winding", ("next:up",), ()),
    ("ceased_trading", "rubric", 5, "ceased ceases cease ceasing", ("close:trading operations operating",), ()),
    ("trade_ban", "rubric", 5, "ban bans banned", (_IMPORTS,), (_CARVE,)),
    ("ceased_manufacturing", "rubric", 5, "ceased ceases cease ceasing", ("close:manufacturing production producing manufacture",), ()),
    ("revoked_authorization", "rubric", 5, "authorization authorizations authorisation authorisations", ("close:revoked revokes revoke revocation",), ()),
    # level 4
    ("trade_restriction", "rubric", 4, "ban bans banned", (_IMPORTS, _CARVE), ()),
    ("going_concern", "rubric", 4, "concern", ("prev:going",), ()),
    ("covenant_breach", "rubric", 4, "covenant covenants", ("close:breach breaches breached breaching waiver waivers waived violation violated",), ()),
    ("late_filing", "rubric", 4, "late delayed overdue", ("close:filing filings accounts",), ()),
    ("auditor_resignation", "rubric", 4, "auditor auditors", ("close:resign resigns resigned resigning resignation quit quits",), ()),
    ("restructuring_advisors", "rubric", 4, "advisors advisers advisor adviser", ("close:restructuring",), ()),
    ("missed_interest_payment", "rubric", 4, "missed misses missing skipped", ("close:interest coupon", "close:payment payments coupon"), ()),
    ("negative_equity", "rubric", 4, "equity", ("close:negative",), ()),
    ("delisting_notice", "rubric", 4, "delisting delisted delist", ("near:notice notices notified exchange criteria",), ()),
    ("emergency_equity_raise", "rubric", 4, "raise raises raised raising offering", ("close:equity share shares", "close:emergency discounted"), ()),
    ("restricted_party_listing", "rubric", 4, "list", ("prev:entity covered sdn",), ()),
    ("restricted_party_listing", "rubric", 4, "ofac", (), ()),
    ("uflpa_detention", "rubric", 4, "uflpa", (), ()),
    ("uflpa_detention", "rubric", 4, "detained detains detention", ("close:customs border",), ()),
    ("plant_closure_or_fire", "rubric", 4, "fire fires", ("near:plant plants factory factories facility facilities",), ()),
    ("plant_closure_or_fire", "rubric", 4, "closure closures closed closes closing shut shuts", ("close:plant plants factory factories facility facilities",), ()),
    ("lost_certification", "rubric", 4, "certification certifications", ("close:lost loses lose losing loss revoked withdrawn withdrawal",), ()),
    ("shipment_delays", "rubric", 4, "shipment shipments", ("close:delay delays delayed late",), ()),
    ("major_recall", "rubric", 4, "recall recalls", ("prev:product safety major nationwide mandatory voluntary",), ()),
    ("major_recall", "rubric", 4, "recall recalls", ("next:of",), ()),
    ("major_recall", "rubric", 4, "recalled recalls recalling", ("close:unit units product products model models display displays",), ()),
    # level 3
    ("sustained_losses", "rubric", 3, "losses", ("close:sustained consecutive sustains sustaining",), ()),
    ("negative_cash_flow", "rubric", 3, "cash", ("next:flow flows", "close:negative"), ()),
    ("covenant_pressure", "rubric", 3, "covenant covenants", ("close:limit limits near nears nearing",), ()),
    ("speculative_downgrade", "rubric", 3, "junk speculative", ("close:downgrade downgrades downgraded rating ratings rated cut cuts grade lowered",), ()),
    ("drawn_revolver", "rubric", 3, "revolver revolving", ("close:drew drawn draws draw drawing",), ()),
    ("layoffs", "rubric", 3, "layoff layoffs", (), ()),
    ("layoffs", "rubric", 3, "laid lay lays laying", ("next:off",), ()),
    ("layoffs", "rubric", 3, "job jobs", ("close:cut cuts cutting",), ()),
    ("asset_sales", "rubric", 3, "asset assets", ("close:sale sales sold sells sell selling",), ()),
    ("regulatory_proceeding", "rubric", 3, "proceeding proceedings", ("close:regulatory regulator regulators",), ()),
    ("regulatory_proceeding", "rubric", 3, "restriction restrictions restrict restricts restricted", ("close:import imports",), ()),
    ("certification_review", "rubric", 3, "certification certifications", ("close:review reviewed reviews",), ()),
    ("single_source_shortage", "rubric", 3, "shortage shortages", ("close:single sole component components",), ()),
    ("ownership_change", "rubric", 3, "acquired bought", ("prev:was were is are been being be",), ()),
    ("ownership_change", "rubric", 3, "acquired bought", ("next:by",), ()),
    ("ownership_change", "rubric", 3, "taken", ("next:over",), ()),
    ("ownership_change", "rubric", 3, "takeover", ("close:bid offer",), ()),
    ("ownership_change", "rubric", 3, "takeover acquisition", ("next:of",), ()),
    ("ownership_change", "rubric", 3, "merger", ("close:with agreement",), ()),
    ("ownership_change", "rubric", 3, "merged", ("next:with into",), ()),
    ("ownership_change", "rubric", 3, "control ownership", ("close:change changes changed",), ()),
    ("ownership_change", "rubric", 3, "owner owners", ("close:new majority",), ()),
    # level 2
    ("sector_downturn", "rubric", 2, "downturn downturns", ("close:sector industry",), ()),
    ("revenue_decline", "rubric", 2, "revenue revenues", ("close:decline declines declined declining fell falls fall drop drops dropped",), ()),
    ("leadership_change", "rubric", 2, "ceo cfo", ("close:resign resigns resigned resignation depart departs departed departure stepped steps appointed appoints appointment new",), ()),
    ("longer_lead_times", "rubric", 2, "lead", ("next:time times", "close:longer extended extends increased increases"), ()),
    ("relocation", "rubric", 2, "relocation relocated relocates relocating relocate", (), ()),
    # level 1
    ("routine_operations", "rubric", 1, "announced", ("close:new",), ()),
    ("routine_operations", "rubric", 1, "opened", ("next:a",), ()),
    ("routine_operations", "rubric", 1, "launched settled results", (), ()),
    ("profitable_results", "rubric", 1, "profitable", (), ()),
    ("profitable_results", "rubric", 1, "profit profits", ("close:record",), ()),
    ("profitable_results", "rubric", 1, "income", ("prev:net",), ()),
    ("normal_refinancing", "rubric", 1, "refinancing refinance refinances refinanced", (), ()),
    # carve-out markers
    ("new_models_only", "mark", 0, "models model", ("close:new", "close:only"), ()),
    ("resolution", "mark", 0, "refinancing refinance refinances refinanced", ("sentence:resolve resolves resolved resolving cure cures cured waiver",), ()),
)

# Conditions that the carve-outs (R15) look at.
BREACH_CONDITIONS = ("covenant_breach",)
GOING_CONCERN_CONDITIONS = ("going_concern",)

# Source tier rules by page host: 1 primary, 2 trade press, 3 general press.
PRIMARY_HOST_PATTERN = (
    r"^(ir|investor|investors|newsroom|press)\.|\.gov$|\.gov\.[a-z][a-z]$|\.gouv\.fr$|\.gc\.ca$|\.mil$"
    r"|(^|\.)europa\.eu$|(^|\.)(court|courts|judiciary|justice)\."
)
PRIMARY_PATH_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/([a-z-]+/)?(newsroom|press-release|press-releases|investors|investor-relations)(/|$)"
TRADE_HOST_PATTERN = r"(trade|industry|journal|magazine|weekly|wire)[a-z-]*\.[a-z]+$"
BLOG_HOST_PATTERN = r"^blog\."
UNKNOWN_TIER = 3

# Abbreviations whose full stop ends no sentence (N1), besides single capitals as in "U.S.".
ABBREVIATIONS = ("Inc", "Ltd", "Corp", "Co", "Cos", "LLC", "plc", "Mr", "Mrs", "Ms", "Dr", "No", "St", "vs", "approx")
# White space that a cell loses at both ends, and the characters that separate words.
STRIP_PATTERN = r"^[\p{Z}\t-\r\x1c-\x1f\x{85}]+|[\p{Z}\t-\r\x1c-\x1f\x{85}]+$"
NON_WORD_PATTERN = r"[^\p{L}\p{N}]+"
