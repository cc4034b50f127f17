"""auditloom: audits of published web reports, written as Spark DataFrame jobs."""
