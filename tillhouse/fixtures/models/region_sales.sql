SELECT region, sum(n_transactions) AS n_transactions
FROM mart_daily_sales_by_store
GROUP BY region
