"""Reference SQL of the whole regression and of advice that rests on it.

The normal equations are summed sparsely (a row has a value only for the design columns that are
not 0 in it), centred within locations, and solved by the sweep operator, one pivot a recursion.
"""

from __future__ import annotations

# Cells: (row, location, design column, value). ``y`` is the target.
FIT_SQL = """
cell AS (
  SELECT listing_id, neighbourhood AS g, 'accommodates' AS name, accommodates AS v FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'bedrooms', bedrooms FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'bathrooms_num', bathrooms_num FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'min_nights', min_nights FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'distance_to_beach_km', distance_to_beach_km
    FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'host_is_superhost',
    CAST(host_is_superhost AS DOUBLE) FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'superhost_missing',
    CAST(superhost_missing AS DOUBLE) FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'no_review_history',
    CAST(no_review_history AS DOUBLE) FROM feat
  UNION ALL SELECT listing_id, neighbourhood, 'room_type_' || room_type, CAST(1 AS DOUBLE)
    FROM feat WHERE room_type <> (SELECT min(room_type) FROM feat)
  UNION ALL SELECT listing_id, neighbourhood, 'property_type_' || property_type,
    CAST(1 AS DOUBLE) FROM feat WHERE property_type <> (SELECT min(property_type) FROM feat)
  UNION ALL SELECT listing_id, neighbourhood, 'y', log_price FROM feat),
size AS (SELECT neighbourhood AS g, count(*) AS n FROM feat GROUP BY 1),
gsum AS (SELECT g, name, sum(v) AS s FROM cell GROUP BY 1, 2),
crossed AS (SELECT a.name AS i, b.name AS j, sum(a.v * b.v) AS v
  FROM cell a JOIN cell b ON a.listing_id = b.listing_id GROUP BY 1, 2),
between_g AS (SELECT a.name AS i, b.name AS j, sum(a.s * b.s / size.n) AS v
  FROM gsum a JOIN gsum b ON a.g = b.g JOIN size ON a.g = size.g GROUP BY 1, 2),
col AS (SELECT name, row_number() OVER (ORDER BY name = 'y', name) AS k
  FROM (SELECT DISTINCT name FROM cell)),
width AS (SELECT count(*) - 1 AS p FROM col),
gram AS (SELECT ci.k AS i, cj.k AS j, coalesce(c.v, 0) - coalesce(w.v, 0) AS v
  FROM col ci CROSS JOIN col cj
  LEFT JOIN crossed c ON c.i = ci.name AND c.j = cj.name
  LEFT JOIN between_g w ON w.i = ci.name AND w.j = cj.name),
swept AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j,
    CAST(v AS DOUBLE) AS v FROM gram
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k + 1 AND j = k + 1 THEN -1 / d0
    WHEN i = k + 1 OR j = k + 1 THEN v / d0 ELSE v - down * across / d0 END
  FROM (SELECT k, i, j, v,
      max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER () AS d0,
      max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY j) AS across,
      max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY i) AS down
    FROM swept WHERE k < (SELECT p FROM width)) step),
solved AS (SELECT i, j, v FROM swept WHERE k = (SELECT p FROM width)),
coef AS (SELECT col.name, e.v AS b, -d.v AS var
  FROM col JOIN solved e ON e.i = col.k JOIN solved d ON d.i = col.k AND d.j = col.k, width
  WHERE e.j = p + 1 AND e.i <= p),
fit AS (SELECT (SELECT v FROM solved WHERE i = p + 1 AND j = p + 1) AS sse,
  (SELECT count(*) FROM feat) - p - (SELECT count(*) FROM size) AS df FROM width)
"""

# Error, two-sided p-value and 95 % interval of every effect. The t tail is the integral of
# cos(u)^(df - 1) by Simpson's rule; the critical value is the expansion around the normal one.
ERRORS_SQL = """
tested AS (SELECT name, b, sqrt(var * sse / df) AS se, b / sqrt(var * sse / df) AS t, df,
  atan(abs(b / sqrt(var * sse / df)) / sqrt(df)) AS low FROM coef, fit),
tail AS (SELECT name, sum(CASE WHEN u = 0 OR u = 4000 THEN 1 WHEN u % 2 = 1 THEN 4 ELSE 2 END
    * pow(cos(low + u * (12 / sqrt(df)) / 4000), df - 1)) * (12 / sqrt(df)) / 4000 / 3
    * 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) AS p
  FROM tested, (SELECT CAST(unnest(range(4001)) AS DOUBLE) AS u) GROUP BY name, df),
z AS (SELECT 1.959963984540054 AS z),
crit AS (SELECT z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z)
  / (96 * pow(df, 2)) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z)
  / (384 * pow(df, 3)) AS c FROM z, fit)
"""

# What scoring needs: location levels, the first of them, and the smearing factor.
SCORE_SQL = """
lvl AS (SELECT gsum.g, sum(CASE WHEN gsum.name = 'y' THEN s ELSE -coef.b * s END) / min(size.n)
    AS level
  FROM gsum JOIN size ON gsum.g = size.g LEFT JOIN coef ON gsum.name = coef.name GROUP BY 1),
base AS (SELECT level AS intercept FROM lvl ORDER BY g LIMIT 1),
told AS (SELECT listing_id, g, sum(CASE WHEN cell.name = 'y' THEN v ELSE -coef.b * v END) AS r
  FROM cell LEFT JOIN coef ON cell.name = coef.name GROUP BY 1, 2),
smear AS (SELECT avg(exp(r - level)) AS smearing FROM told JOIN lvl ON told.g = lvl.g)
"""

# Requests ``ask`` scored by the rules that each one's own row counts: a location is kept from 29
# other rows on, and a property type if fewer than eight others are ahead of it.
HEDONIC_SQL = """
fill AS (SELECT median(accommodates) AS a, median(bedrooms) AS b, median(bathrooms_num) AS c,
  median(min_nights) AS m, median(distance_to_beach_km) AS d FROM listings),
kinds AS (SELECT property_type, count(*) AS n FROM listings WHERE price > 0 GROUP BY 1),
rivals AS (SELECT property_type AS rival, n AS rival_n FROM kinds
  ORDER BY n DESC, property_type LIMIT 9),
numbered AS (SELECT *, row_number() OVER () AS row FROM ask),
ranked AS (SELECT numbered.row, count(rivals.rival) AS ahead
  FROM numbered LEFT JOIN kinds ON kinds.property_type = coalesce(numbered.property_type, 'Other')
  LEFT JOIN rivals ON rivals.rival <> coalesce(numbered.property_type, 'Other')
    AND (rival_n > coalesce(kinds.n, 0) + 1 OR (rival_n = coalesce(kinds.n, 0) + 1
      AND rivals.rival < coalesce(numbered.property_type, 'Other')))
  GROUP BY 1),
ready AS (SELECT numbered.*, CASE WHEN ahead < 8 THEN coalesce(property_type, 'Other')
    ELSE 'Other' END AS kind,
  CASE WHEN numbered.neighbourhood IS NULL THEN NULL
    WHEN coalesce(hoods.rows, 0) + 1 >= 30 THEN numbered.neighbourhood ELSE 'Other' END AS place
  FROM numbered JOIN ranked USING (row)
  LEFT JOIN hoods ON hoods.neighbourhood = numbered.neighbourhood),
given AS (
  SELECT row, 'accommodates' AS name, coalesce(accommodates, fill.a) AS v FROM ready, fill
  UNION ALL SELECT row, 'bedrooms', coalesce(bedrooms, fill.b) FROM ready, fill
  UNION ALL SELECT row, 'bathrooms_num', coalesce(bathrooms_num, fill.c) FROM ready, fill
  UNION ALL SELECT row, 'min_nights', coalesce(min_nights, fill.m) FROM ready, fill
  UNION ALL SELECT row, 'distance_to_beach_km', fill.d FROM ready, fill
  UNION ALL SELECT row, 'host_is_superhost', CASE WHEN host_is_superhost THEN 1.0 ELSE 0.0 END
    FROM ready
  UNION ALL SELECT row, 'superhost_missing',
    CASE WHEN host_is_superhost IS NULL THEN 1.0 ELSE 0.0 END FROM ready
  UNION ALL SELECT row, 'no_review_history',
    CASE WHEN coalesce(number_of_reviews, 0) = 0 THEN 1.0 ELSE 0.0 END FROM ready
  UNION ALL SELECT row, 'room_type_' || room_type, 1.0 FROM ready WHERE room_type IS NOT NULL
  UNION ALL SELECT row, 'property_type_' || kind, 1.0 FROM ready),
explained AS (SELECT row, sum(coalesce(coef.b, 0) * given.v) AS x
  FROM given LEFT JOIN coef ON given.name = coef.name GROUP BY 1),
valued AS (SELECT ready.*, exp(intercept + x + coalesce(lvl.level - intercept, 0)) * smearing AS h,
  lvl.g IS NOT NULL AND place <> 'Other' AS known
  FROM ready JOIN explained USING (row) LEFT JOIN lvl ON lvl.g = ready.place, base, smear),
req AS (SELECT *, neighbourhood AS nb, room_type AS rt,
  CASE WHEN accommodates > 999 OR accommodates <= 0 THEN NULL WHEN accommodates <= 2 THEN '1-2'
    WHEN accommodates <= 4 THEN '3-4' WHEN accommodates <= 6 THEN '5-6'
    WHEN accommodates > 6 THEN '7+' END AS cb,
  CASE WHEN current_price > 0 THEN current_price ELSE h END AS price FROM valued)
"""

ADVICE_SQL = """
placed AS (SELECT *, CASE t WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS m,
  CASE t WHEN 0 THEN i0 WHEN 1 THEN i1 WHEN 2 THEN i2 WHEN 3 THEN i3 ELSE 0 END AS iqr,
  CAST(CASE t WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE 0 END AS BIGINT)
    AS n_effective
  FROM peer),
advised AS (SELECT *, 0.5 * h + 0.5 * m AS anchor,
  greatest(0.5 * h + 0.5 * m - 0.5 * iqr, 0.5 * (0.5 * h + 0.5 * m)) AS low,
  0.5 * h + 0.5 * m + 0.5 * iqr AS high,
  CASE WHEN pct < 0.33 THEN 'below market' WHEN pct > 0.66 THEN 'above market'
    ELSE 'in line' END AS position_label FROM placed)
"""

REQUESTS_SQL = """
ask AS (SELECT l_orderkey * 10 + l_linenumber AS request_id,
  CASE WHEN l_partkey % 37 = 0 THEN 'Nowhere' WHEN l_partkey % 41 = 0 THEN NULL
    ELSE 'NATION_' || (l_suppkey % 25) END AS neighbourhood,
  CASE WHEN l_partkey % 43 = 0 THEN 'Treehouse' ELSE ['AUTOMOBILE', 'BUILDING', 'FURNITURE',
    'HOUSEHOLD', 'MACHINERY'][1 + l_suppkey % 5] END AS room_type,
  CASE WHEN l_partkey % 3 = 0 THEN l_linestatus || ' 5-LOW' ELSE p_type END AS property_type,
  CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE CAST(1 + p_size % 9 AS DOUBLE) END AS accommodates,
  CAST(1 + l_suppkey % 3 AS DOUBLE) AS bedrooms,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE CAST(1 + l_suppkey % 2 AS DOUBLE) END
    AS bathrooms_num,
  CAST(l_linenumber AS DOUBLE) AS min_nights, l_returnflag = 'A' AS host_is_superhost,
  l_quantity AS number_of_reviews,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1
    THEN round(l_extendedprice, 0) * 4 ELSE 0.0 END AS current_price
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""

PROFILES_SQL = """
rooms AS (SELECT neighbourhood, arg_min(room_type, (-n, room_type)) AS room_type
  FROM (SELECT neighbourhood, room_type, count(*) AS n FROM listings GROUP BY 1, 2) GROUP BY 1),
homes AS (SELECT neighbourhood, arg_min(property_type, (-n, property_type)) AS property_type
  FROM (SELECT neighbourhood, property_type, count(*) AS n FROM listings GROUP BY 1, 2)
  GROUP BY 1),
ask AS (SELECT (SELECT min(listing_id) FROM listings l WHERE l.neighbourhood = rooms.neighbourhood)
    AS request_id, neighbourhood, room_type, property_type, 2.0 AS accommodates, 1.0 AS bedrooms,
  1.0 AS bathrooms_num, 2.0 AS min_nights, false AS host_is_superhost, 20.0 AS number_of_reviews,
  CAST(NULL AS DOUBLE) AS current_price FROM rooms JOIN homes USING (neighbourhood))
"""
