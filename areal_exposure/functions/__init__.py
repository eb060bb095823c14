"""Column functions: nothing here touches a DataFrame or starts a job."""
