"""orderlens.functions"""
