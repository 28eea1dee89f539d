--BUCKET: 1 hour lag 1
SELECT
    unix_timestamp(window(ts, '1 hour').start) AS time_ts,
    avg(value) AS value
FROM events
WHERE {{FILTERS}} AND event_type = :event_type
GROUP BY 1
--HAVING-- time_ts = --BUCKET--
