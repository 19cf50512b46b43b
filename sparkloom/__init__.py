"""sparkloom: a property-graph analytics engine expressed as PySpark DataFrame plans."""
