"""Service-request analytics as Spark DataFrame transformations.

Every operator takes and returns a lazy DataFrame built from built-in Spark
expressions; nothing in the package collects rows to the driver.
"""
