"""The theme vocabulary and its two-tier classification.

A theme is admitted by any specific term, or by two different generic terms where it
allows generic corroboration; exclusion phrases are blanked first. Generic terms that don't admit are
refused, and can be reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Theme:
    key: str
    theme_id: str
    since: str
    specific: tuple[str, ...]
    generic: tuple[str, ...] = ()
    exclusions: tuple[str, ...] = ()
    generic_admits: bool = True


#: Themes, the day from which buyers are detectable, and their terms (case-insensitive).
THEMES = (
    Theme("warehouse_automation", "THEME-01", "2026-08-24", (r"\bWMS\b", r"warehouse management system", r"warehouse execution", r"\bAS/RS\b", r"goods[- ]to[- ]person", r"pick(ing)? automation", r"fulfil?ment (automation|optimization)", r"material handling", r"warehouse (automation|robotics)", r"\bautomated storage\b"), (r"\bAMR\b",)),
    Theme("data_analytics_ai", "THEME-02", "2026-08-24", (r"\bartificial intelligence\b", r"machine learning", r"\bgen(erative)?[ -]?AI\b", r"\bagentic( AI)?\b", r"\bAI (agents?|copilots?|assistants?)\b", r"\bdata (platform|strategy|governance|warehouse|lake)\b", r"\banalytics\b", r"business intelligence", r"predictive (analytics|maintenance)", r"\bdata[- ]driven\b", r"\bdigital twin\b"), (r"\bAI\b(?![-\w])",)),
    Theme("erp_core_systems", "THEME-03", "2026-08-24", (r"\bERP\b", r"S/4\s?HANA", r"\bNetSuite\b", r"\bDynamics 365\b", r"\bEpicor\b", r"\bJD Edwards\b", r"core (system|platform) (modernization|migration|replacement)"), (r"\bSAP\b", r"\bOracle\b", r"\bInfor\b")),
    Theme("systems_integration", "THEME-04", "2026-08-24", (r"\bEDI\b", r"\biPaaS\b", r"middleware", r"\bETL\b", r"system(s)? interoperability", r"data integration"), (r"\bAPI\b", r"\bintegration\b"), (r"post[- ]merger integration",)),
    Theme("digital_transformation_process", "THEME-05", "2026-08-24", (r"digital transformation", r"\bmodernization\b", r"operational excellence", r"process (improvement|excellence|reengineering|automation)", r"continuous improvement", r"Six Sigma", r"change management", r"\bRPA\b", r"robotic process automation", r"workflow automation"), (r"\bLean\b",)),
    Theme("transportation_fleet_systems", "THEME-06", "2026-08-22", (r"\bTMS\b", r"transportation management system", r"telematics", r"route (optimization|planning)", r"fleet (management|technology|optimization)", r"last[- ]mile", r"freight (visibility|audit|optimization)")),
    Theme("cloud_infrastructure_migration", "THEME-07", "2026-08-31", (r"cloud (migration|modernization|transformation|adoption)", r"\blift and shift\b", r"\bdata cent(er|re) (migration|exit)\b"), (r"\bmainframe\b", r"legacy (system|application) modernization", r"application modernization", r"\bAzure\b", r"\bAWS\b", r"\bGCP\b"), generic_admits=False),
    Theme("cybersecurity", "THEME-08", "2026-08-31", (r"\bcyber ?security\b", r"\bOT security\b", r"\bIT/OT\b", r"zero trust", r"\bransomware\b", r"security (posture|assessment|operations)", r"\bNIST\b", r"\bCMMC\b")),
    Theme("workforce_enablement", "THEME-09", "2026-08-31", (r"frontline (worker|technology|enablement)", r"workforce (management|enablement)", r"\bdeskless\b", r"labo(u)?r (management|productivity|standards)", r"training and (adoption|enablement)", r"user adoption")),
    Theme("ot_modernization", "THEME-10", "2026-09-02", (r"\bSCADA\b", r"\bPLC\b", r"\bICS\b", r"\bDCS\b", r"programmable logic controller", r"distributed control system", r"industrial control system", r"\bHMI\b", r"human[- ]machine interface", r"process historian", r"data historian", r"control system (upgrade|migration|modernization|replacement)", r"plant[- ]floor (connectivity|network|system)", r"industrial network", r"\bOT (network|infrastructure|modernization)\b", r"shop[- ]floor (connectivity|system)")),
)

#: Stand-ins over the invented prose of test tables: common stems, so that the same rules fire there.
PROSE_THEMES = (
    Theme("stems_the", "P-01", "2024-01-01", (r"(^|\s)thing(\s|\.|$)", r"(^|\s)this(\s|$)"), (r"(^|\s)the(\s|$)", r"(^|\s)and(\s|$)")),
    Theme("stems_der", "P-02", "2024-01-08", (r"(^|\s)nicht(\s|$)",), (r"(^|\s)der(\s|$)", r"(^|\s)die(\s|$)"), (r"und der",)),
    Theme("stems_que", "P-03", "2024-01-15", (r"(^|\s)para(\s|$)",), (r"(^|\s)que(\s|$)", r"(^|\s)del(\s|$)"), generic_admits=False),
    Theme("stems_les", "P-04", "2024-01-15", (r"(^|\s)les(\s|$)",)),
)


def required(pattern: str) -> str:
    """The longest run of plain characters, in lower case, that every match of a pattern has; blank if none is known.

    Groups, classes and whatever may be missing are passed over, so the run may be shorter than it could be but is never wrong.
    """
    rest = re.sub(r"\\[bBsSwWdD](\{[^}]*\}|[*+?])?", "\0", pattern)
    rest = re.sub(r"\\(.)", lambda m: m.group(1) if m.group(1) in "-/" else "\0", rest)
    rest = re.sub(r"\[[^\]]*\](\{[^}]*\}|[*+?])?", "\0", rest)
    inner = r"\([^()]*\)(\{[^}]*\}|[*+?])?"
    while re.search(inner, rest):
        rest = re.sub(inner, "\0", rest)
    if "|" in rest:
        return ""
    rest = re.sub(r".[*?]|.\{[^}]*\}", "\0", rest)
    return max(re.split(r"[\0.+^$(){}\[\]\\]", rest), key=len).lower()


def first_hits(text: Column, low: Column, patterns: tuple[str, ...]) -> Column:
    """The first match of each pattern that has one. `low` is the text in lower case: what lacks a pattern's required run is not searched for it."""
    found = [F.when(F.contains(low, F.lit(required(p))), F.regexp_extract(text, f"(?i){p}", 0)) for p in patterns]
    return F.filter(F.array(*found) if found else F.array().cast("array<string>"), lambda x: x != "")


def classify(text: Column, themes: tuple[Theme, ...] = THEMES) -> Column:
    """Array of structs (theme, admitted, hits) of the themes with any hit.

    The text and its lower case are worked out once for all terms, the hits of a theme once for what is told of it.
    """
    return _once(F.coalesce(text, F.lit("")), lambda own: _once(F.lower(own), lambda low: F.array_compact(F.array(*[_theme(own, low, t) for t in themes]))))


def _theme(text: Column, low: Column, t: Theme) -> Column:
    """What a theme's terms show, null if nothing; exclusions are blanked first where there are any."""
    if t.exclusions:
        blanked = text
        for p in t.exclusions:
            blanked = F.regexp_replace(blanked, f"(?i){p}", " ")
        plain = _theme(text, low, replace(t, exclusions=()))
        some = reduce(or_, [F.contains(low, F.lit(required(p))) for p in t.exclusions])
        return F.when(some, _once(blanked, lambda own: _once(F.lower(own), lambda o: _theme(own, o, replace(t, exclusions=()))))).otherwise(plain)
    generic = lambda g: (F.size(F.array_distinct(F.transform(g, F.lower))) >= 2) if t.generic_admits else F.lit(False)
    return _once(
        F.struct(first_hits(text, low, t.specific).alias("s"), first_hits(text, low, t.generic).alias("g")),
        lambda h: F.when((F.size(h["s"]) > 0) | (F.size(h["g"]) > 0), F.struct(F.lit(t.key).alias("theme"), ((F.size(h["s"]) > 0) | generic(h["g"])).alias("admitted"), F.concat(h["s"], h["g"]).alias("hits"))),
    )


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
