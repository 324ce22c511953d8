"""sparkloom: grounded retrieval analytics and corpus processing on Spark."""
