"""SQL templates and statements analysed as data.

A tokenizer and a small clause walker find kind, tables, columns by usage, joins, CTEs,
functions and flags of PostgreSQL statements. Templates with directives in block comments are
lexed, their alternatives rendered to at most ``MOST_VARIANTS`` statements and the analyses of
the variants united.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from evigraph.functions.mask import mask_sql

MOST_VARIANTS = 32
_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\$(\w*)\$.*?\$\1\$|"(?:[^"]|"")*"|[A-Za-z_\u0080-￿][\w$\u0080-￿]*|\d+(?:\.\d+)?|::|->>?|<>|!=|<=|>=|\|\||[^\s]""",
    re.DOTALL,
)
_WORD = re.compile(r'^(?:[A-Za-z_\u0080-￿][\w$\u0080-￿]*|"(?:[^"]|"")*")$')
# Words that end a table reference or can't name a column.
KEYWORDS = frozenset(
    """select from where and or not in is null like ilike between exists case when then else end as on using join inner left right full outer
    cross natural lateral group by having order limit offset union all distinct except intersect insert into values update set delete merge matched
    returning conflict do nothing default with recursive truncate table asc desc nulls first last true false any some for only window over partition
    rows range filter cast interval current_date current_timestamp restart identity continue cascade restrict fetch next row locked skip nowait share""".split()
)
READ, CREATE, UPDATE, DELETE = "READ", "CREATE", "UPDATE", "DELETE"


@dataclass
class Statement:
    kind: str = "UNKNOWN"
    normalized_sql: str = ""
    tables: dict[str, dict] = field(default_factory=dict)
    columns: set[tuple[str, str, str]] = field(default_factory=set)
    joins: list[dict] = field(default_factory=list)
    ctes: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    has_where: bool = False
    has_subquery: bool = False
    dynamic: bool = False
    warnings: list[str] = field(default_factory=list)


def tokens(sql: str) -> list[str]:
    return [t for m in _TOKEN.finditer(sql) if (t := m.group()) and not t.isspace() and not t.startswith(("--", "/*"))]


def name_of(token: str) -> str:
    return token[1:-1].replace('""', '"') if token.startswith('"') else token.lower()


def is_name(token: str) -> bool:
    return bool(_WORD.match(token)) and token.lower() not in KEYWORDS


def split_statements(sql: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens(sql):
        if t == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


class Walker:
    """One pass over a statement's tokens with a stack of clauses, one per parenthesis."""

    def __init__(self, toks: list[str]) -> None:
        self.t, self.low, self.s = toks, [x.lower() for x in toks], Statement()

    def analyse(self) -> Statement:
        s, low = self.s, self.low
        at = self._ctes()
        verb = low[at] if at < len(low) else ""
        kinds = {"select": "SELECT", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "merge": "MERGE", "truncate": "TRUNCATE"}
        s.kind = kinds.get(verb, "UNKNOWN")
        s.has_where = "where" in low
        s.has_subquery = any(a == "(" and b in ("select", "with") for a, b in zip(low, low[1:])) and (at == 0 or "select" in low[at + 1 :])
        if s.kind == "UNKNOWN":
            s.warnings.append("UNKNOWN statement kind")
        elif s.kind == "TRUNCATE":
            self._truncate(at + 1)
        else:
            self._clauses()
        if s.kind in ("INSERT", "MERGE") and self._upserts():
            for t in s.tables.values():
                if t["direct_target"]:
                    t["operations"].add(UPDATE)
        return s

    def _upserts(self) -> bool:
        text = " ".join(self.low)
        return self.s.kind == "MERGE" or bool(re.search(r"\bon conflict\b.*\bdo update\b", text))

    def _ctes(self) -> int:
        """Names of leading CTEs; the place of the main verb."""
        low = self.low
        if not low or low[0] != "with":
            return 0
        i = 1 + (low[1:2] == ["recursive"])
        while i < len(low):
            self.s.ctes.add(name_of(self.t[i]))
            i += 1
            if i < len(low) and low[i] == "(":
                i = self._close(i) + 1
            while i < len(low) and low[i] != "(":
                i += 1
            i = self._close(i) + 1
            if i < len(low) and low[i] == ",":
                i += 1
                continue
            break
        return i

    def _close(self, i: int) -> int:
        depth = 0
        for k in range(i, len(self.t)):
            depth += (self.t[k] == "(") - (self.t[k] == ")")
            if depth == 0:
                return k
        return len(self.t) - 1

    def _truncate(self, i: int) -> None:
        while i < len(self.t):
            if is_name(self.t[i]):
                i = self._table(i, "TRUNCATE", True)
            else:
                i += 1

    def _table(self, i: int, kind: str, target: bool) -> int:
        """Read a table reference at ``i``; the place after it and its alias."""
        parts = [name_of(self.t[i])]
        i += 1
        while i + 1 < len(self.t) and self.t[i] == "." and _WORD.match(self.t[i + 1]):
            parts.append(name_of(self.t[i + 1]))
            i += 2
        if i < len(self.t) and self.t[i] == "(" and not target:
            self.s.functions.add(parts[-1])
            return i
        alias = ""
        if i < len(self.t) and self.low[i] == "as":
            i += 1
        if i < len(self.t) and is_name(self.t[i]) and kind != "TRUNCATE":
            alias = name_of(self.t[i])
            i += 1
        schema, table = (parts[-2] if len(parts) > 1 else "", parts[-1])
        if not schema and table in self.s.ctes:
            return i
        operation = {"INSERT": CREATE, "MERGE": CREATE, "UPDATE": UPDATE, "DELETE": DELETE, "TRUNCATE": DELETE}.get(kind) if target else READ
        entry = self.s.tables.setdefault(f"{schema}.{table}", {"schema": schema, "table": table, "alias": alias, "operations": set(), "direct_target": False})
        entry["operations"].add(operation)
        entry["direct_target"] |= target
        return i

    def _clauses(self) -> None:
        t, low, s = self.t, self.low, self.s
        stack, clause, i = [], "", 0
        pending_target = False
        while i < len(t):
            w = low[i]
            if w == "(":
                stack.append(clause)
                if clause == "target":
                    clause = "insert_columns"
                elif clause in ("table", "using"):
                    clause = "" if low[i + 1 : i + 2] in (["select"], ["with"]) else clause
                i += 1
            elif w == ")":
                clause = stack.pop() if stack else ""
                clause = "table_end" if clause in ("table",) else clause
                i += 1
            elif w in ("select", "having", "values", "limit", "offset"):
                clause = "referenced"
                i += 1
            elif w in ("group", "order") and low[i + 1 : i + 2] == ["by"]:
                clause = "referenced"
                i += 2
            elif w in ("from", "into", "update", "join", "using") and not (w == "update" and low[i - 1 : i] in (["do"], ["for"], ["then"])) and not (w == "from" and low[i - 1 : i] == ["distinct"]):
                if w == "join":
                    self._join(i)
                target = (w == "into") or (w == "update" and s.kind == "UPDATE") or (w == "from" and low[i - 1 : i] == ["delete"])
                if w == "using" and t[i + 1 : i + 2] == ["("] and low[i + 2 : i + 3] != ["select"]:
                    end = self._close(i + 1)
                    s.columns.update(("", name_of(c), "JOIN") for c in t[i + 2 : end] if is_name(c))
                    i = end + 1
                    continue
                clause, pending_target = ("target" if target else "table"), target
                i += 1
                while low[i : i + 1] in (["only"], ["lateral"]):
                    i += 1
                if i < len(t) and is_name(t[i]):
                    i = self._table(i, s.kind if target else "SELECT", target)
            elif w == "," and clause in ("table", "table_end") and i + 1 < len(t) and is_name(t[i + 1]):
                i = self._table(i + 1, "SELECT", False)
                clause = "table"
            elif w == "on" and low[i + 1 : i + 2] == ["conflict"]:
                clause = "referenced"
                i += 2
            elif w == "on":
                clause = "join"
                i += 1
            elif w == "where":
                clause = "where"
                i += 1
            elif w == "set":
                clause = "set"
                i += 1
            elif w == "returning":
                clause = "returning"
                i += 1
            elif w == "," and clause == "set_value":
                clause = "set"
                i += 1
            elif w == "=" and clause == "set":
                clause = "set_value"
                i += 1
            elif w in ("left", "right", "full", "cross", "natural", "inner", "outer"):
                clause = "table_end" if clause in ("join", "table", "table_end") else clause
                i += 1
            elif is_name(t[i]):
                i = self._column(i, clause)
            else:
                i += 1
        if pending_target:
            return

    def _column(self, i: int, clause: str) -> int:
        t, s = self.t, self.s
        parts = [name_of(t[i])]
        j = i + 1
        while j + 1 < len(t) and t[j] == "." and (_WORD.match(t[j + 1]) or t[j + 1] == "*"):
            parts.append(name_of(t[j + 1]) if t[j + 1] != "*" else "*")
            j += 2
        if j < len(t) and t[j] == "(":
            s.functions.add(parts[-1])
            return j
        if len(parts) == 1 and parts[0] in s.ctes and self.low[j : j + 1] in (["as"], ["("]):
            return j  # the CTE's own head
        if t[i - 1 : i] in (["as"], ["AS"], ["::"]) or (i and (self._ends_expression(i - 1) and clause in ("referenced", "returning"))):
            return j  # an output alias or a type name
        usage = {"where": "WHERE", "join": "JOIN", "insert_columns": "INSERT_TARGET", "set": "UPDATE_TARGET", "returning": "RETURNING"}.get(clause, "REFERENCED")
        if parts[-1] != "*" and clause not in ("table", "table_end", "target"):
            s.columns.add((parts[-2] if len(parts) > 1 else "", parts[-1], usage))
        return j

    def _ends_expression(self, i: int) -> bool:
        w = self.t[i]
        return w == ")" or (is_name(w) and self.low[i] not in KEYWORDS) or w[:1] in "'\"" or w[:1].isdigit() or self.low[i] == "end"

    def _join(self, i: int) -> None:
        low, t = self.low, self.t
        before = low[max(0, i - 3) : i]
        kind = next((k.upper() for k in ("left", "right", "full", "cross", "natural") if k in before), "INNER")
        j = i + 1 + (low[i + 1 : i + 2] in (["lateral"], ["only"]))
        right = []
        if j < len(t) and t[j] == "(":
            end = self._close(j)
            right = ["(subquery)"]
            j = end + 1
        else:
            while j < len(t) and (_WORD.match(t[j]) or t[j] == ".") and low[j] not in ("on", "using", "where", "left", "right", "full", "inner", "cross", "natural", "join", "group", "order", "as"):
                right.append(t[j])
                j += 1
                if not (j < len(t) and t[j] == ".") and right[-1] != ".":
                    break
        while j < len(t) and low[j] not in ("on", "using", "join", "where", "group", "order", ")", "left", "right", "full", "inner", "cross"):
            j += 1
        condition: list[str] = []
        if j < len(t) and low[j] == "on":
            depth, j = 0, j + 1
            while j < len(t):
                depth += (t[j] == "(") - (t[j] == ")")
                if depth < 0 or (depth == 0 and low[j] in ("join", "where", "group", "order", "left", "right", "full", "inner", "cross", "natural", "limit", "returning", "union", "having", "set")):
                    break
                condition.append(t[j])
                j += 1
        text = re.sub(r"\s*\.\s*", ".", " ".join(condition))
        self.s.joins.append({"join_type": kind, "right_item": "".join(right), "condition": mask_sql(text)})


def analyse(sql: str, dynamic: bool = False) -> list[Statement]:
    """The statements of a text, literals masked; nothing in it is run."""
    out = []
    for toks in split_statements(sql):
        try:
            s = Walker(toks).analyse()
        except (IndexError, RecursionError) as e:
            s = Statement(warnings=[str(e).splitlines()[0] if str(e) else "unreadable statement"])
        s.normalized_sql = mask_sql(re.sub(r"\s*\.\s*", ".", " ".join(toks)))
        s.dynamic = dynamic
        if dynamic:
            s.warnings.append("dynamic template")
        out.append(s)
    return out


# Directives of SQL templates ------------------------------------------------------------------------

_BLOCK = re.compile(r"/\*(.*?)\*/", re.DOTALL)
_LITERAL = re.compile(r"\s*('(?:[^']|'')*'|\((?:[^()']|'(?:[^']|'')*')*\)|-?\d+(?:\.\d+)?|true\b|false\b|null\b|date\s*'[^']*'|[A-Za-z_]\w*\b)", re.IGNORECASE)


@dataclass
class Directive:
    kind: str
    expression: str
    start: int


def lex_template(sql: str) -> list[str | Directive]:
    """Text and directives; comments that are neither directive nor bind stay text."""
    out: list[str | Directive] = []
    at = 0
    for m in _BLOCK.finditer(sql):
        if m.start() < at:
            continue
        body = m[1]
        end = m.end()
        kind = ""
        if body.startswith("%"):
            word, _, rest = body[1:].strip().partition(" ")
            kind = {"if": "IF", "elseif": "ELSEIF", "else": "ELSE", "end": "END", "for": "FOR", "expand": "EXPAND", "populate": "POPULATE"}.get(word.lower(), "OTHER")
            body = rest
        elif body.startswith("#"):
            kind, body = "EMBEDDED_VARIABLE", body[1:]
        elif body.startswith("^") and (lit := _LITERAL.match(sql, end)):
            kind, body, end = "LITERAL_VARIABLE", body[1:], lit.end()
        elif re.match(r"^\s*[A-Za-z_@]", body) and (lit := _LITERAL.match(sql, end)) and not _is_clause(lit[1]):
            kind, end = "BIND_VARIABLE", lit.end()
        if not kind:
            continue
        out.append(sql[at : m.start()])
        out.append(Directive(kind, body.strip(), m.start()))
        if kind in ("BIND_VARIABLE", "LITERAL_VARIABLE"):
            out.append("(?)" if lit[1].startswith("(") else "?")
        elif kind == "POPULATE":
            out.append("dynamic_column = ?")
        elif kind == "EMBEDDED_VARIABLE":
            out.append(" " + re.sub(r"\W", "_", body.strip()) + " ")
        elif kind == "EXPAND" and (star := re.compile(r"\s*\*").match(sql, end)):
            out.append("*")
            end = star.end()
        at = end
    out.append(sql[at:])
    return [x for x in out if x != ""]


def _is_clause(word: str) -> bool:
    return word.lower() in KEYWORDS - {"true", "false", "null", "interval", "current_date", "current_timestamp"}


def variants(sql: str) -> list[str]:
    """Statements that the alternatives of a template can make, at most ``MOST_VARIANTS``; loops once."""
    parts = lex_template(sql)
    pos = 0

    def sequence() -> list[str]:
        nonlocal pos
        made = [""]
        while pos < len(parts):
            p = parts[pos]
            if isinstance(p, str):
                made = [m + p for m in made]
                pos += 1
            elif p.kind == "IF":
                options = choice()
                made = list(dict.fromkeys(m + o for m in made for o in options))[:MOST_VARIANTS]
            elif p.kind == "FOR":
                pos += 1
                body = sequence()
                pos += 1
                made = list(dict.fromkeys(m + o for m in made for o in body))[:MOST_VARIANTS]
            elif p.kind in ("ELSEIF", "ELSE", "END"):
                break
            else:
                pos += 1
        return made

    def choice() -> list[str]:
        nonlocal pos
        options: list[str] = []
        while pos < len(parts):
            pos += 1
            options.extend(sequence())
            if pos >= len(parts) or parts[pos].kind == "END":
                pos += 1
                break
        return list(dict.fromkeys(options))[:MOST_VARIANTS]

    made: list[str] = []
    while pos < len(parts):
        more = sequence()
        made = more if not made else [a + b for a in made for b in more]
        if pos < len(parts):
            pos += 1  # an end without a beginning
    return list(dict.fromkeys(re.sub(r"\s+", " ", m).strip() for m in made))[:MOST_VARIANTS]


def is_dynamic(sql: str) -> bool:
    return any(isinstance(p, Directive) and p.kind in ("IF", "FOR", "EMBEDDED_VARIABLE", "EXPAND", "POPULATE") for p in lex_template(sql))


def unite(statements: list[Statement]) -> Statement:
    """Analyses of a template's variants as one."""
    out = Statement(kind=statements[0].kind, normalized_sql=statements[0].normalized_sql)
    for s in statements:
        for k, t in s.tables.items():
            mine = out.tables.setdefault(k, {**t, "operations": set()})
            mine["operations"] |= t["operations"]
            mine["direct_target"] |= t["direct_target"]
        out.columns |= s.columns
        out.joins += [j for j in s.joins if j not in out.joins]
        out.ctes |= s.ctes
        out.functions |= s.functions
        out.has_where |= s.has_where
        out.has_subquery |= s.has_subquery
        out.dynamic |= s.dynamic
        out.warnings += [w for w in s.warnings if w not in out.warnings]
    return out


def analyse_template(sql: str) -> list[Statement]:
    """One analysis per statement of a template, its variants united."""
    dynamic = is_dynamic(sql)
    by_place: dict[int, list[Statement]] = {}
    for v in variants(sql):
        for i, s in enumerate(analyse(v, dynamic)):
            by_place.setdefault(i, []).append(s)
    return [unite(by_place[i]) for i in sorted(by_place)]
