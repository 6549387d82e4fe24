"""SQL side of the example data: named common table expressions for the checking engine."""

from __future__ import annotations

from compovec.functions import text as T
from compovec.sources import ontology


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(expr: str, digits: int = 8) -> str:
    """Rounded double without a negative zero."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0e0)"


WS = lit(T.WHITESPACE)
IDS = "[" + ",".join(lit(i) for i in ontology.ids()) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    for pat, rep in (("\\n+", " "), ("\\t+", " "), (" +", " "), ("_+", "_"), ("-+", "-"), ("\\.+", ".")):
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    return strip(f"replace({x}, '*', '')")


def shield_points(x: str) -> str:
    s = T.SHIELDED[0]
    for _ in range(2):
        x = f"regexp_replace({x}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1{s}\\2', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])ex\\.', '\\1ex{s}', 'g')"
    return x


def shield_spans(x: str, pattern: str) -> str:
    p = lit(pattern)
    return (f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {p}), regexp_extract_all({x}, {p})), "
            f"lambda z: z[1] || coalesce(translate(z[2], '{T.TERMINATORS}', '{T.SHIELDED}'), '')), '')")


def pieces(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, {lit(T.PIECE)}), lambda y: {strip('y')}), "
            "lambda y: y <> '')")


# name -> (needed names, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    """A full statement: the needed expressions in dependency order, then the select."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in needs:
        visit(n)
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in seen)
    return (f"WITH {head} " if head else "") + select


def domain_rows() -> str:
    vals = []
    for i, (code, did, name, pilot) in enumerate(ontology.domains()):
        vals.append(f"({i}, {lit(code)}, {lit(did)}, {lit(name)}, {str(pilot).lower()}, {lit(code[:2])})")
    return f"SELECT * FROM (VALUES {', '.join(vals)}) t(ord, code, id, name, pilot_active, grp)"


cte("domains", domain_rows())
