"""SQL counterparts of the fixture recipes, as common table expressions."""

from __future__ import annotations

PARTS = {
    "scanned": """
  SELECT "row_id", rpad(area || dtext, 4, ' ') || ((row_id // 90) % 10)::VARCHAR
           || chr((65 + (row_id // 900) % 26)::INT) || chr((65 + (row_id // 23400) % 26)::INT) AS "Postcode",
         area AS "Postcode_area", quality AS "Quality",
         (CASE WHEN quality = 90 THEN 0 ELSE (row_id * 7919) % 700000 END)::INT AS "Eastings",
         (CASE WHEN quality = 90 THEN 0 ELSE (row_id * 104729) % 1250000 END)::INT AS "Northings",
         CASE WHEN area IN ('AB','EH','IV') THEN 'S92000003' WHEN area = 'CF' THEN 'W92000004' ELSE 'E92000001' END AS "Country_code",
         CASE WHEN quality NOT IN (60, 90) AND row_id % 3 <> 0 THEN 'C' || (row_id % 27)::VARCHAR END AS "Admin_county_code",
         CASE WHEN quality NOT IN (60, 90) THEN 'D' || (c % 40)::VARCHAR END AS "Admin_district_code",
         CASE WHEN quality NOT IN (60, 90) THEN 'W' || (c % 64)::VARCHAR END AS "Admin_ward_code"
  FROM (SELECT *, CASE WHEN d <= 5 THEN d::VARCHAR || CASE WHEN q = 0 THEN '' ELSE q::VARCHAR END WHEN d <= 7 THEN d::VARCHAR || q::VARCHAR
            ELSE d::VARCHAR || CASE WHEN q = 0 THEN 'W' ELSE chr((64 + q)::INT) END END AS dtext
        FROM (SELECT o_orderkey AS row_id, o_custkey AS c, (o_orderkey // 10) % 9 + 1 AS d, (o_orderkey // 608400) % 10 AS q,
                (['NG','TQ','AB','EH','CF','SW','E','B','IV','NE'])[(o_orderkey % 10 + 1)::INT] AS area,
                CASE WHEN o_orderkey % 50 = 0 THEN 90 WHEN o_orderkey % 49 = 0 THEN 60 WHEN o_orderkey % 17 = 0 THEN 50 ELSE 10 END AS quality
              FROM orders))""",
    "areas": """
  SELECT (['NG','TQ','AB','EH','CF','SW','E','B','IV','NE','ZE','HS','KW','PH','DD','FK','LL','SY','TR','PL','EX','TA','BA','GL','HR'])[n_nationkey + 1] AS "Postcode Area", n_name AS "Post Town"
  FROM nation""",
    "countries": """
  SELECT * FROM (VALUES ('E92000001','England'), ('S92000003','Scotland'), ('W92000004','Wales'), ('N92000002','N. Ireland'))
    AS t("Country Code", "Country Name")""",
    "counties": """
  SELECT n_name AS "County Name", 'C' || n_nationkey::VARCHAR AS "County Code" FROM nation""",
    "districts": """
  SELECT CASE n % 4 WHEN 0 THEN 'Vale ' || n::VARCHAR || ' District' WHEN 1 THEN 'Moor ' || n::VARCHAR || ' District (B)'
           WHEN 2 THEN 'Port ' || n::VARCHAR
           ELSE CASE WHEN n = 3 THEN 'City of London' ELSE 'London Borough of Court ' || n::VARCHAR END END AS "District Name",
         'D' || n::VARCHAR AS "District Code"
  FROM (SELECT DISTINCT c_custkey % 38 AS n FROM customer)""",
    "wards": """
  SELECT 'Mill ' || n::VARCHAR || CASE WHEN n % 5 = 1 THEN ' ED' ELSE ' Ward' END AS "Ward Name", 'W' || n::VARCHAR AS "Ward Code"
  FROM (SELECT DISTINCT p_partkey % 60 AS n FROM part)""",
    "named": """
  SELECT s.*, a."Post Town", n."Country Name", c."County Name", d."District Name", w."Ward Name"
  FROM scanned s LEFT JOIN areas a ON s."Postcode_area" = a."Postcode Area"
    LEFT JOIN countries n ON s."Country_code" = n."Country Code" LEFT JOIN counties c ON s."Admin_county_code" = c."County Code"
    LEFT JOIN districts d ON s."Admin_district_code" = d."District Code" LEFT JOIN wards w ON s."Admin_ward_code" = w."Ward Code\"""",
    "parted": """
  SELECT *, regexp_extract("Outward", '([A-Z][A-Z]?)([0-9].*)', 2) AS "District"
  FROM (SELECT *, regexp_replace(regexp_replace(trim("Postcode"), '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g') AS "Pattern",
          trim(right("Postcode", 3)) AS "Inward", trim(left("Postcode", length("Postcode") - 3)) AS "Outward" FROM named)""",
    "grid": """
  SELECT *, CASE substr(name, 1, 1)
      WHEN 'S' THEN strpos('ABCFGLQ', substr(name, 2, 1)) = 0 WHEN 'T' THEN strpos('BCDEHJKNOPSTUWXYZ', substr(name, 2, 1)) = 0
      WHEN 'N' THEN strpos('EPQV', substr(name, 2, 1)) = 0 WHEN 'H' THEN strpos('ABCDEFGHJKLMNOQRSV', substr(name, 2, 1)) = 0
      WHEN 'O' THEN substr(name, 2, 1) = 'V' ELSE false END AS is_real
  FROM (SELECT e::INT AS easting_index, n::INT AS northing_index,
          substr('STNOHJ', ((n // 5) * 2 + e // 5 + 1)::INT, 1)
            || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', ((4 - n % 5) * 5 + e % 5 + 1)::INT, 1) AS name
        FROM range(10) AS x(e), range(15) AS y(n))""",
    "cells": """
  SELECT event_id // 100 AS "row", event_id % 100 AS col,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 5.5::DOUBLE
              WHEN (event_id // 100) % 40 >= 36 AND event_id % 100 >= 90 THEN -1000.0::DOUBLE
              ELSE ((((event_id // 100) // 7) * 3 + (event_id % 100) // 9) % 5)::DOUBLE END AS alt
  FROM events""",
    "heights": """
  SELECT o_orderkey AS k, ((o_orderkey * 7919) % 14700)::DOUBLE / 10.0 - 20.0 AS alt FROM orders""",
    "near": """
  SELECT c."row", c.col, c.alt, d."row" AS nrow, d.col AS ncol, d.alt AS nalt
  FROM cells c JOIN (SELECT a AS dr, b AS dc FROM range(-1, 2) AS x(a), range(-1, 2) AS y(b) WHERE a <> 0 OR b <> 0) s ON true
    JOIN cells d ON d."row" = c."row" + s.dr AND d.col = c.col + s.dc""",
    "seeds": """
  SELECT c."row", c.col, c.alt,
         CASE WHEN c.alt = -1000 OR coalesce(n.same, 0) >= 6 THEN 1 ELSE 0 END AS seed
  FROM cells c LEFT JOIN (SELECT "row", col, count(*) AS same FROM near WHERE abs(alt - nalt) < 0.01 GROUP BY ALL) n
    ON c."row" = n."row" AND c.col = n.col""",
    "flood": """
  SELECT "row", col FROM seeds WHERE seed = 1 AND alt <> -1000
  UNION
  SELECT n.nrow, n.ncol FROM flood f JOIN near n ON n."row" = f."row" AND n.col = f.col
  WHERE abs(n.alt - n.nalt) < 0.01 AND n.nalt <> -1000""",
    "marked": """
  SELECT s."row", s.col, s.alt, CASE WHEN s.seed = 1 THEN 1 WHEN f."row" IS NOT NULL THEN 2 ELSE 0 END AS water
  FROM seeds s LEFT JOIN flood f ON s."row" = f."row" AND s.col = f.col""",
    "counted": """
  SELECT alt, count(*) AS cases FROM cells GROUP BY alt""",
    "extent": """
  SELECT min_e - m AS e0, min_n - m AS n0, max_e + m AS e1, max_n + m AS n1
  FROM (SELECT *, trunc(greatest(max_e - min_e, max_n - min_n) * 0.1::DOUBLE)::BIGINT AS m
        FROM (SELECT min("Eastings")::BIGINT AS min_e, max("Eastings")::BIGINT AS max_e, min("Northings")::BIGINT AS min_n, max("Northings")::BIGINT AS max_n
              FROM scanned WHERE "Eastings" <> 0))""",
}

NEEDS = {
    "named": ["scanned", "areas", "countries", "counties", "districts", "wards"],
    "parted": ["named"], "near": ["cells"], "seeds": ["near"], "flood": ["seeds"], "marked": ["flood"],
    "counted": ["cells"], "extent": ["scanned"],
}


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for part in [*_ordered(NEEDS.get(name, [])), name]:
            if part not in out:
                out.append(part)
    return out


def sql(needs: str, body: str, **more: str) -> str:
    """``body`` after the named parts (and ``more`` of its own), each as a common table expression."""
    parts = [f"{name} AS ({PARTS[name]})" for name in _ordered(needs.split())]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}" if parts else body


def floor_div(a: str, b: str) -> str:
    """Float floor division for b > 0."""
    a, b = f"({a})::DOUBLE", f"({b})::DOUBLE"
    return f"floor(({a} - {a} % {b}) / {b} - CASE WHEN {a} % {b} < 0 THEN 1.0 ELSE 0.0 END + 0.5)"


def mix(number: str, seed: int) -> str:
    """The portable pseudo-random number of ``functions.numeric.mix_hash``."""
    p = 2147483647
    x = f"((({number}) % {p} + {seed + 1}) % {p})"
    h = f"(({x} * 48271) % {p})"
    h = f"(({h} * {h} + {x}) % {p})"
    return f"(({h} * {h} + {x}) % {p})"


def wide(number: str, seed: int) -> str:
    return f"({mix(number, seed)} * 2147483648 + {mix(number, seed + 7)})"


def ramp(stops: list, eff: str) -> list[str]:
    """r, g, b of an effective altitude by a land ramp, truncated."""
    out = []
    for ch, at_top in enumerate((255, 0, 0)):
        case = f"CASE WHEN {eff} < {stops[0][0]} OR {eff} > {stops[-1][0]} THEN 0.0"
        for (lo_alt, lo), (hi_alt, hi) in zip(stops, stops[1:]):
            case += f" WHEN {eff} < {hi_alt} THEN {lo[ch]} - {lo[ch] - hi[ch]} * (({eff} - {lo_alt}) / {hi_alt - lo_alt}::DOUBLE)"
        out.append(f"trunc({case} ELSE {at_top} END)::INT")
    return out
