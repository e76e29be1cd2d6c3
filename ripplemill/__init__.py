"""ripplemill: information-propagation analytics as plain PySpark DataFrame jobs."""
