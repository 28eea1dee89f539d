SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
FROM customer
GROUP BY c_mktsegment
