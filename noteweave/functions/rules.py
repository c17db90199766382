"""Rule data loading (driver side, small) and pattern helpers.

Rule files are data (``resources/``); they are read on the driver into plain
lists that are shipped to tasks inside the UDF closure or compiled into
Column predicates.  Their size is fixed by the rule set, not by the data.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
DEID_DIR = os.path.join(RESOURCES, "deid_rules")
CONTEXT_DIR = os.path.join(RESOURCES, "context_rules")

# Report sections that are de-identified (working fields) and
# header fields whose values are sensitive, as in the shipped task settings.
WORKING_FIELDS = ["Finding", "Text", "ContentSequence", "ImageComments"]
SENSITIVE_FIELDS = [
    "Patient ID", "Patient Name", "Person Observer Name",
    "Referring Physician Name", "Consulting Physician Name", "Performing Physician Name",
    "Name Of Physicians Reading Study", "Operators Name", "Other Patient Names",
    "Patient Birth Name", "Patient Mother Birth Name", "Secondary Reviewer Name",
    "Evaluator Name", "Scheduled Performing Physician Name",
    "Names Of Intended Recipients Of Results", "Human Performer Name",
    "Verifying Observer Name", "Person Name", "Content Creator Name", "Reviewer Name",
    "Institution Name", "Institution Address", "Institutional Department Name",
    "Patient Address", "Other Names",
]


@dataclass
class DeidRule:
    rule_no: int
    category: str
    pattern: str
    flags: list[str]
    labels: list[str]
    data_type: str
    disabled: bool = False
    test_true: list[str] = field(default_factory=list)
    test_false: list[str] = field(default_factory=list)

    def re_flags(self) -> int:
        f = 0
        if "multiline" in self.flags:
            f |= re.MULTILINE
        if "ignorecase" in self.flags:
            f |= re.IGNORECASE
        return f


def load_deid_rules(folder: str = DEID_DIR, name_pattern: str = r".*_rules\.json$",
                    group: str = "PHI_rules") -> list[DeidRule]:
    """All rule files matching ``name_pattern`` (sorted by name), one group.

    A later file replaces a same-named category; categories keep first-seen
    order.  Disabled rules are kept (flagged) so that the catalogue is whole.
    """
    cats: dict[str, list] = {}
    for fn in sorted(os.listdir(folder)):
        if not re.match(name_pattern, fn):
            continue
        with open(os.path.join(folder, fn), encoding="utf-8") as fh:
            data = json.load(fh)
        for cat, rules in data.get(group, {}).items():
            cats[cat] = rules if isinstance(rules, list) else [rules]
    out: list[DeidRule] = []
    for cat, rules in cats.items():
        for r in rules:
            out.append(DeidRule(len(out), cat, r["pattern"], list(r.get("flags", [])),
                                list(r.get("data_labels", [])), r.get("data_type", ""),
                                bool(r.get("disabled", False)), list(r.get("test_true", []) or []),
                                list(r.get("test_false", []) or [])))
    return out


def re2_compatible(pattern: str) -> bool:
    """Whether a rule can run in an RE2 engine (no look-around, ``\\Z`` or ``[\\b``)."""
    return not re.search(r"\(\?<[=!]|\(\?[=!]|\\Z|\[\\b", pattern)


# What the patterns hold that an RE2 engine lacks, and what stands for it there.  A look-behind
# becomes a consumed character (its rules' matches end in a digit, so it is never part of the match before);
# a backspace is no word character anyway; two capitals of a postcode are never ``mm``; ``(?!and )`` is
# dropped, which is exact where no second or third word of a name is an "and".
RE2_PARTS = [
    ("(?<![\\.0-9A-Za-z])", "(?:^|[^\\.0-9A-Za-z])"),
    ("\\Z", "\\z"),
    ("[\\b\\W]", "\\W"),
    ("(?![0-9]mm)", ""),
    ("(?!and )", ""),
]


def re2_form(pattern: str) -> str:
    """The pattern for an RE2 engine (see RE2_PARTS)."""
    for part, stand_in in RE2_PARTS:
        pattern = pattern.replace(part, stand_in)
    return pattern


# ---------------------------------------------------------------- context rules

@dataclass
class ContextRule:
    name: str          # rule file name
    offset: int        # -1 before, 1 after, 0 document head, 100 mention string, -100 cut-off
    regs: list[str]
    case_sensitive: bool = False
    containing: bool = False
    more_context_sents: list[int] = field(default_factory=list)

    def wrapped(self) -> list[str]:
        """Patterns as the matcher sees them (cut-off literals stay literal)."""
        if self.offset == -100:
            return list(self.regs)
        out = []
        for p in self.regs:
            if self.containing:
                out.append(".*" + p + ".*")
            elif not p.startswith("^") and not p.endswith("$"):
                out.append("^" + p + "$")
            else:
                out.append(p)
        return out


@dataclass
class ContextConfig:
    rules: list[ContextRule]
    skip_terms: list[str]
    osf_patterns: list[str]


def _load(path: str):
    with open(path, encoding="utf-8") as fh:
        return json.load(fh)


def load_context_config(active: list[str] | None = None, skip_file: str | None = "general_cris_skip_terms.json",
                        osf_files: list[str] | None = None, folder: str = CONTEXT_DIR) -> ContextConfig:
    """Active rule files in order (rule name = file name), skip terms, original-string rules.

    With no ``active`` list the default configuration file is used.
    """
    if active is None:
        cfg = _load(os.path.join(folder, "_default_rule_config.json"))
        active = cfg["active_rules"]
        if skip_file == "general_cris_skip_terms.json" and "skip_term_setting" in cfg:
            skip_file = os.path.basename(cfg["skip_term_setting"])
    rules = []
    for fn in active:
        for r in _load(os.path.join(folder, fn)):
            rules.append(ContextRule(fn, int(r["offset"]), list(r["regs"]), bool(r.get("case_sensitive", False)),
                                     bool(r.get("containing_pattern", False)), list(r.get("more_context_sents", []))))
    skips = _load(os.path.join(folder, skip_file)) if skip_file else []
    osf = []
    for fn in osf_files or []:
        osf += _load(os.path.join(folder, fn))
    for r in rules:  # a bad pattern stops the run, as in the original
        for p in r.wrapped():
            if r.offset != -100:
                re.compile(p)
    return ContextConfig(rules, skips, osf)
