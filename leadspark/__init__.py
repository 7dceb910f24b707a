"""leadspark: lead scoring and campaign attribution as PySpark DataFrame operators."""
