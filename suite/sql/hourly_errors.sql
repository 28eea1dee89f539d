SELECT window(ts, '1 hour').start AS time, event_type, count(*) AS cnt
FROM events
WHERE {{FILTERS}} AND event_type IN ('error', 'click')
GROUP BY 1, 2
