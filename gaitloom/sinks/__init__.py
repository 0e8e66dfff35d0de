"""Writers that publish whole versions."""
