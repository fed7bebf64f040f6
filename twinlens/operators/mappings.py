"""Rule spellings and rule mappings: small configured tables, built on the driver and used as constant look-ups."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower, canonical_rule, lookup, strip
from ..functions.values import CONFIDENCES, RULES, SPELLINGS, TOOLS

#: The note of a mapping that comes from an alias.
FROM_ALIAS = "from an alias"
ALPHABET = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical_base(rule: str) -> str:
    """As the column expression of the same name, for configured rules."""
    c = re.sub(r"(?s)^.*\((.*)\)$", r"\1", rule.strip())
    c = re.sub(r"(?s)^.*/", "", c)
    c = re.sub(r"[_ \-]+", "-", c)
    c = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[^\-])(?=[A-Z][a-z])", "-", c)
    return c.translate(ALPHABET).strip("-")


def rule_key(code: str) -> str:
    return code.strip().translate(ALPHABET)


@dataclass
class Mappings:
    """Configured mappings and aliases.

    ``rules``: dicts of baseline_tool, baseline, candidate_tool, candidate, confidence; ``aliases``: dicts of tool to rule. An
    alias maps each pair of its rules exactly, and gives all of them, everywhere, the name its first rule goes by at that point.
    """

    rules: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        rank = lambda t: TOOLS.index(t)
        rows = set()

        def add(t1: str, c1: str, t2: str, c2: str, confidence: str) -> None:
            a, b = sorted([(rank(t1), c1.strip()), (rank(t2), c2.strip())])
            rows.add((*a, *b, CONFIDENCES.index(confidence)))

        for r in self.rules:
            add(r["baseline_tool"], r["baseline"], r["candidate_tool"], r["candidate"], r.get("confidence", "exact"))
        for group in self.aliases:
            own = [(t, group[t]) for t in TOOLS if group.get(t)]
            for i in range(len(own)):
                for other in own[i + 1 :]:
                    add(*own[i], *other, "exact")
        #: (left tool, left code, right tool, right code, confidence), tools and confidences as ordinals, in look-up order.
        self.table = sorted(rows)
        self.spellings = {r: r for r in RULES} | dict(SPELLINGS)
        for group in self.aliases:
            names = [canonical_base(group[t]) for t in TOOLS if group.get(t)]
            if names:
                target = self.spellings.get(names[0], names[0])
                self.spellings |= dict.fromkeys(names, target)

    def canonical(self, code: Column) -> Column:
        return canonical_rule(code, self.spellings)

    def canonical_name(self, code: str) -> str:
        """As ``canonical``, for one rule."""
        base = canonical_base(code)
        return self.spellings.get(base, base)

    def knows(self, tool: str, code: str, other: str) -> bool:
        """Whether ``endpoint_confidence`` has one for a rule."""
        own = (TOOLS.index(tool), rule_key(code), TOOLS.index(other))
        listed = any(own in ((t1, rule_key(c1), t2), (t2, rule_key(c2), t1)) for t1, c1, t2, c2, _ in self.table)
        return listed or self.canonical_name(code) in RULES

    def explicit(self) -> dict[str, str]:
        """Confidence ordinal by ``tool:code|tool:code`` in both directions; the first in order wins."""
        out: dict[str, str] = {}
        for t1, c1, t2, c2, conf in self.table:
            a, b = f"{TOOLS[t1]}:{rule_key(c1)}", f"{TOOLS[t2]}:{rule_key(c2)}"
            out.setdefault(f"{a}|{b}", str(conf))
            out.setdefault(f"{b}|{a}", str(conf))
        return out

    def endpoint_confidence(self, tool: Column, code: Column, other_tool: Column, canonical: Column | None = None) -> Column:
        """Whether a rule is known against another tool: the least configured confidence, else exact for built-in rules, else null."""
        ends: dict[str, str] = {}
        for t1, c1, t2, c2, conf in self.table:
            for k in (f"{TOOLS[t1]}:{rule_key(c1)}|{TOOLS[t2]}", f"{TOOLS[t2]}:{rule_key(c2)}|{TOOLS[t1]}"):
                ends[k] = min(ends.get(k, str(conf)), str(conf))
        found = lookup(F.concat(end_key(tool, code), F.lit("|"), other_tool), ends).cast("int")
        own = self.canonical(code) if canonical is None else canonical
        return F.coalesce(found, F.when(own.isin(*RULES), 0))

    def component(self, tool: Column, code: Column, canonical: Column) -> Column:
        """A name shared by all rules that might be matched with each other; null for a null code.

        Rules match by equal canonical names or a configured pair, so components follow from the configuration alone.
        """
        up: dict[str, str] = {}

        def root(x: str) -> str:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        names = lambda c: self.spellings.get(canonical_base(c), canonical_base(c))
        spelt: dict[str, set[str]] = {}
        for t1, c1, t2, c2, _ in self.table:
            a, b = f"{TOOLS[t1]}:{rule_key(c1)}", f"{TOOLS[t2]}:{rule_key(c2)}"
            up[root(a)] = root(b)
            for k, c in ((a, c1), (b, c2)):
                spelt.setdefault(k, set()).add("=" + names(c))
        for k, cs in spelt.items():
            for c in cs:
                up[root(k)] = root(c)
        of_end = {k: root(k) for k in spelt}
        of_name = {k[1:]: root(k) for k in up if k.startswith("=")}
        by_name = F.coalesce(lookup(canonical, of_name), F.concat(F.lit("="), canonical))
        return F.coalesce(lookup(end_key(tool, code), of_end), by_name) if of_end else by_name

    def configured_counts(self, left: str, right: str) -> tuple[int, int]:
        """Configured exact and approximate mappings between two tools."""
        pair = sorted([TOOLS.index(left), TOOLS.index(right)])
        own = [c for t1, _, t2, _, c in self.table if [t1, t2] == pair]
        return own.count(0), own.count(1)

    def oriented(self, baseline: str, candidate: str) -> list[dict]:
        """The mappings between two tools as configured, turned to baseline and candidate, sorted, with their notes."""
        rows = set()
        for r in self.rules:
            ends = {r["baseline_tool"]: r["baseline"], r["candidate_tool"]: r["candidate"]}
            if set(ends) == {baseline, candidate}:
                rows.add((ends[baseline], ends[candidate], CONFIDENCES.index(r.get("confidence", "exact")), r.get("notes") or ""))
        for group in self.aliases:
            if group.get(baseline) and group.get(candidate):
                rows.add((group[baseline], group[candidate], 0, FROM_ALIAS))
        return [{"baseline_tool": baseline, "baseline": x, "candidate_tool": candidate, "candidate": y, "confidence": CONFIDENCES[z]} | ({"notes": n} if n else {}) for x, y, z, n in sorted(rows)]


def end_key(tool: Column, code: Column) -> Column:
    return F.concat(tool, F.lit(":"), ascii_lower(strip(code)))
