"""Part of the velado engine."""
